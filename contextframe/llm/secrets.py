"""Credentials embedded in source code, configuration, logs and prose.

All places of a text on which a credential's value can stand are collected: assignments, also
with the value in the next line or in several strings, forms of their own (URLs, headers,
flags, logins, elements, calls), issued keys by their prefix, and literals of sentences that
speak of a credential. Viterbi segmentation then explains as much of each value as it can by
dictionary words; what no word explains is its residual, and a value with a long residual is
a credential. Only private keys have a form that needs no such test.

Placeholders, references to variables and vaults, names, paths, ids, public keys, blobs,
formats of password hashes, digests that are named as such and digests of nothing are none.
Hexadecimal digits of a digest's length in a credential's own place are one, because keys
are often written so.

The dictionary is counted over all rows and whole texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a word must occur in: one in SHARE_ROWS, so the same words at every size, and at least LEAST_ROWS,
#: or the few copies of a literal in a small table would explain it.
SHARE_ROWS, LEAST_ROWS = 4_000, 4
#: Unexplained characters that make a literal a credential near a context, and in running text.
RESIDUAL, RESIDUAL_PROSE = 3, 7
#: Those of a place that holds nothing but credentials and of words joined to digits, of letters of one case, and of a pass phrase.
RESIDUAL_STRONG, RESIDUAL_PLAIN, RESIDUAL_PHRASE = 2, 10, 6
#: Least characters of a literal, and in running text; most words of a pass phrase.
LEAST_CHARS, LEAST_PROSE, PHRASE_WORDS = 6, 10, 8
MASK = "********"

#: Words for credentials in code and in the languages of the texts.
_NAMES = "password passwd passphrase passcode pwd pass secret token apikey credential credentials creds auth authtoken bearer".split()
_KEY_OF = "api access secret signing sign encryption encrypt private account auth service deploy master client webhook hmac shared".split()
_OTHER_NAMES = ("kennwort", "passwort", "geheimnis", "zugangsschlüssel", "contraseña", "clave", "mot_de_passe", "senha", "chave", "segredo", "wachtwoord", "sleutel", "geheim", "пароль", "ключ", "секрет", "токен", "密码", "密钥", "口令", "令牌")
#: Words after which a name is no longer that of the credential itself, and words before it.
_NOT_AFTER = "name names field fields header headers path paths file files url uri endpoint id ids type kind count limit length len ttl expiry expires expiration policy budget hash digest fingerprint checksum env var ref reference store cache index map list size prefix suffix hint label reset rotation age manager provider usage stats cost".split()
_NOT_BEFORE = "max min num n public pub total used remaining hashed no".split()
_PROSE = re.compile(
    r"(?i)\b(?:pass ?(?:word|code|phrase)|pw|pwd|passwd|secret|credentials?|creds|access key|secret key|api key|deploy token|access token|token|bearer|key"
    r"|kennwort|passwort|geheimnis|geheimschlüssel|zugangsschlüssel|schlüssel|zugangstoken"
    r"|contraseña|clave|token de acceso|mot de passe|jeton|clé|senha|chave|segredo|palavra-passe"
    r"|wachtwoord|sleutel|toegangssleutel|geheim|toegangstoken"
    r"|парол\w*|ключ\w*|секрет\w*|токен\w*)(?![\w])|密码|密钥|口令|令牌|凭证|钥匙|秘钥"
)
#: What makes a key one of data and not a credential.
_OTHER_KEYS = re.compile(r"(?i)\b(?:cache|primary|public|foreign|partition|sort|row|idempotency|group|lookup|dedup\w*|hash|map|dict|object|host)[ -]$")
#: Hash contexts: what stands right before a digest, and names of what holds one.
_HASHES = re.compile(r"(?i)(?:\b(?:commit|sha\d*|sha-\d+|md5|etag|digest|checksum|fingerprint|integrity|revision|rev|blake\d?\w*|hash|trace_id|request_id|uuid|guid|nonce|build|image|layer|tree|parent|index|ref)\b[\"']?\s*[:=@]?\s*[\"'(]?(?:w/)?[\"']?|sha\d+[:-]|md5:|@sha256:)$")
_BLOB = re.compile(r"(?i)(?:base64,|ssh-(?:rsa|ed25519|dss)\s+|ecdsa-\S+\s+|data:\S*)$")
#: Prefixes of issued credentials, with what follows them.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|sk-(?:proj-)?[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}"
    r"|xox[abprs]-[\w-]{16,}|AIza[\w-]{20,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{20,}|hvs\.[\w-]{16,}|SG\.[\w-]{8,}\.[\w-]{16,}|dop_v1_[0-9a-f]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>|\[.*\]|\{.*\}|\(.*\)|%[\w ]+%|(?-i:\$[A-Z_][A-Z0-9_]*|\$[a-z_]+)|\$[({].*|.*\$\{.*|.*\{\{.*|\.{2,}|…|(.)\1{3,}|.*(.)\2{5,}.*|.*\*{4,}.*|[x*•#-]+"
    r"|(?:.*[^a-z])?(?:redacted|replace(?:[-_ ]?me)?|change[-_ ]?me|placeholder|example|dummy|your|insert|todo|fixme|masked|removed|hidden|xxxx+|not[-_]?set|undefined|sample|fake)(?:[^a-z].*)?"
    r"|none|null|nil|true|false|str|string|bytes|int|bool|optional|any|self|required|empty|unset|n/?a|password|passwd|secret|token|test|admin|root|user|foo|bar|basic|bearer|vault:.*|secret:.*|ref:.*|env:.*|arn:.*|file:.*|op://.*|ssm:.*)$"
)
_CODE = re.compile(r"^(?:[A-Za-z_][\w]*(?:\.|::|->)[A-Za-z_].*|.*\(.*|[A-Za-z_]\w*\[.*|process\.env.*|os\.environ.*|[&*]?[a-z_]+(?:<.*|\|.*)?)$")
_IDENTIFIER = re.compile(r"^[A-Za-z]?[a-z]+\d{0,2}(?:[A-Z][a-z]+\d{0,2}|[_-][A-Za-z]?[a-z]+\d{0,2})*$|^[A-Z]+\d{0,2}(?:_[A-Z]+\d{0,2})*$|^[A-Z][a-z]*(?:-[A-Z][a-z]*)+$")
_PATH = re.compile(r"^(?:[./~]|\w+:/)?(?:[\w.\[\]-]+/)+[\w.\[\]-]*(?::\d+)*$|^[\w-]+\.(?:py|rs|ts|tsx|js|go|java|md|sql|toml|json|ya?ml|txt|test|example|invalid|com|org|net|io)(?::\d+)*$|^[\w.-]+::[\w:]+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
#: Words joined to digits by a sign, as people build passwords; words may explain all but the digits.
_BUILT = re.compile(r"^[A-Za-z]{3,}[^\w\s/:@]?_?[A-Za-z]*\d{3,}[^\s/:@]{0,2}$")
_BUILT_SHORT = re.compile(r"^[A-Z][a-z]{2,}[-_.!][a-z]{3,}\d{2,}[^\s/:@]{0,2}$")
_TIME = re.compile(r"^\d{4}-\d\d-\d\d(?:[T ].*)?$|^[\d:.,+-]+Z?$|^v?\d+(?:\.\d+)+\S{0,8}$")
_HEX = re.compile(r"^(?:[0-9a-f]{7,8}|[0-9a-f]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$")

#: A name with what assigns to it; the name begins where no other could, so that no text is read twice.
_ASSIGNED = re.compile(r"(?<![\w.\-])(?P<name>[\w.\-]++)(?:\\*+[\"'`]\]?|\])?+(?:[ \t]++string)?[ \t]*+(?::=|=>|==?|:|：|＝)[ \t]*+")
#: The type between a name's colon and what assigns to it.
_TYPED = re.compile(r"(?:&(?:'\w++ )?)?[A-Za-z_][\w.\[\]<>:]*+(?:[ \t]*+\|[ \t]*+None)?[ \t]++=(?![=>])[ \t]*+")
#: What may stand between a name and the value that it names.
_USED = re.compile(r"(?i)[\w.\-]*+[\"'`\]\\]*+[ \t]*+[:=：>]*+[ \t]*+(?:(?:bearer|basic|token)[ \t]++)?[\"'`\\]*+")
#: A name and its value in two fields of one entry.
_PAIR = re.compile(r"(?i)\b(?:name|key)[\"']?[ \t]*+[:=][ \t]*+[\"']?(?P<name>[\w.\-]++)[\"']?,?\s*+[\"']?value[\"']?[ \t]*+[:=][ \t]*+")
#: Ways to begin a literal, a literal in quotes, and one without.
_OPENED = re.compile(r"(?:(?:String::from|Some|str)\()?(?:[bruf]{1,2}(?=[\"']))?")
_QUOTED = re.compile(r"\"(?P<d>(?:[^\"\\\n]|\\.)*+)\"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<t>[^`\n]*+)`|«\s?(?P<f>[^«»\n]*+)»|\\+\"(?P<e>[^\"\\\n]*+)\\+\"|\\+'(?P<g>[^'\\\n]*+)\\+'")
_BARE = re.compile(r"[^\s\"'`,;<>«»]+")
_BARE_ON = re.compile(r"[,;](?![\w.\-]+[\"']?[ \t]*[:=])(?P<v>[^\s\"'`,;<>«»]{4,})")
#: What joins the quoted parts of one literal: on a line, over a line's end, and within brackets by the line's end alone.
_JOINED = re.compile(r"([\"'][ \t]*(?:(?:\+|\.\.?|&)?[ \t]*|\\\r?\n[ \t]*|(?:\+|\.\.?|&)[ \t]*\r?\n[ \t]*|\r?\n[ \t]*(?:\+|\.\.?|&)[ \t]*)[\"'])")
_JOINED_LINES = re.compile(r"([\"'][ \t]*(?:\+|\.\.?|&)?[ \t]*\r?\n[ \t]*(?:\+|\.\.?|&)?[ \t]*[\"'])")
_JOINED_ANY = re.compile(f"{_JOINED.pattern}|{_JOINED_LINES.pattern}")
#: What may stand after an assignment whose value is in the next line, and before a value there.
_NEXT = re.compile(r"[|>][-+\d]{0,2}[ \t]*\r?$|[(\[{\\]?[ \t]*\r?$", re.M)
_NEXT_LEAD = re.compile(r"\s*+(?:[-*>#][ \t]++|//[ \t]*+)*+(?:[\"']?(?:value|data|default|string|text|literal)[\"']?[ \t]*+[:=][ \t]*+)?")
_SCHEMES = [
    ("url", "url", re.compile(r"(?i)(?<![a-z0-9+.-])[a-z0-9+.-]*+://[^\s/:@\"'<>]*+:(?P<v>[^\s/@\"'<>]++)@")),
    ("url", "query", re.compile(r"(?i)[?&;](?:access_token|api_?key|apikey|auth|token|secret|client_secret|password|passwd|pwd|sig|signature|key)=(?P<v>[^\s&#\"'<>]++)")),
    ("header", "name", re.compile(r"(?i)\b(?:bearer|basic)[ \t]++(?P<v>[\w+/=.~!*-]{8,})")),
    ("header", "name", re.compile(r"(?i)\bauthorization[\"']?[ \t]*+[:=][ \t]*+[\"']?(?:token|apikey|digest)[ \t]++(?P<v>[\w+/=.~-]{8,})")),
    ("header", "name", re.compile(r"(?i)(?<![\w-])(?=x-[\w-]*?(?:key|token|secret|auth))[\w-]++[\"']?[ \t]*+:[ \t]*+[\"']?(?P<v>[^\s\"',]{8,})")),
    ("flag", "user", re.compile(r"(?i)(?<!\S)(?:-u|--user(?:name)?)[ =][\"']?[\w.@-]++:(?P<v>[^\s\"']++)")),
    ("flag", "name", re.compile(r"(?i)(?<!\S)--?(?:[a-z-]*pass(?:word|wd|phrase)?|[a-z-]*token|[a-z-]*secret|api-key)[ =][\"']?(?P<v>[^\s\"']++)")),
    ("login", "name", re.compile(r"(?i)\blogin[ \t:=]++[^\s:=]++\s++pass(?:word)?[ \t:=]++[\"']?(?P<v>[^\s\"']++)")),
    ("login", "name", re.compile(r"(?i)\bcre(?:ds|dentials)[ \t]*+[:=][ \t]*+[\w.@-]++[ \t]*+[/:|,][ \t]*+[\"'`]?(?P<v>[^\s\"'`,;]++)")),
    ("login", "identified", re.compile(r"(?i)\bidentified[ \t]++by[ \t]++[\"'](?P<v>[^\"'\n]++)[\"']")),
    ("element", "name", re.compile(r"(?i)<(?=[\w:]*?(?:password|passwd|secret|token|apikey|passphrase|credential)|[\w:-]*?api-key)[\w:-]++>[ \t]*+(?P<v>[^<\n]++)</")),
    ("call", "call", re.compile(r"(?i)(?<![\w.:])(?P<call>[\w.:]++)\((?:[^()\n\"']*+(?:\"[^\"()\n]*+\"|'[^'()\n]*+')?+,)*+[ \t]*+[\"'](?P<v>[^\"'\s]{8,})[\"'][ \t]*+\)")),
    ("hook", "hook", re.compile(r"(?i)https?://hooks?\.[^\s/\"'<>]++/(?:services|workflows|triggers)/(?P<v>[\w-]++/[\w-]++/[A-Za-z0-9]{12,})")),
]
_CALL = re.compile(r"(?i)(?:credential|auth|login|password|secret|token|connect|client)\w*(?:(?:::|\.)\w+)?$")
_MYSQL = re.compile(r"(?i)\bmysql")
_MYSQL_FLAG = re.compile(r"(?<!\S)-p[\"']?(?P<v>[^\s\"'-][^\s\"']*)")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What stands between the lines of a key and before them, the headers of a key, and a line of its body.
_KEY_GAP = re.compile(r"(?:\\[rnt]|[\s>|#\"'`,\\-]|\+(?=\s|[\"']))*")
_KEY_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset): [^\n\\]*")
_KEY_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}(?=\\[rn]|[\s\"'`,;)\]}<…\\]|\.\.\.|\Z)")
_KEY_LINE_END = re.compile(r"[ \t\r\"'`,;+]*(?:\\[rn]|\n|\\|…|\.\.\.|\Z)")
_CHUNK = re.compile(r"[^\s\"'`<>(){}\[\],;«»“”„‘’、，。：；（）]+")
#: Where a sentence ends, and where the part of it ends that speaks of one thing: with the braces and brackets of data, too.
_SENTENCE = re.compile(r"[.!?。！？](?:\s|$)")
_APART = re.compile(r"[.!?。！？](?:\s|$)|[{}\[\]]")
#: What every place of a kind has on its line, in lower case; only there are patterns tried.
_PREFIXES = "akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- sk_live_ sk_test_ rk_live_ rk_test_ xoxa- xoxb- xoxp- xoxr- xoxs- aiza npm_ pypi- hvs. sg. dop_v1_ eyj".split()
_KEYWORDS = {
    "issued": _PREFIXES,
    "name": ["pass", "pwd", "pw", "secret", "token", "key", "cred", "auth", "bearer", "basic", "login", "kennwort", "geheim", "schlüssel", "contraseñ", "clave", "mot de passe", "mot_de_passe", "jeton", "clé", "senha", "chave", "segredo", "palavra-passe", "wachtwoord", "sleutel", "парол", "ключ", "секрет", "токен", "密码", "密钥", "口令", "令牌", "凭证", "钥匙", "秘钥"],
    "url": ["://"],
    "query": ["token=", "key=", "auth=", "secret=", "password=", "passwd=", "pwd=", "sig=", "signature="],
    "user": ["-u ", "-u=", "--user"],
    "identified": ["identified"],
    "call": ["credential", "auth", "login", "password", "secret", "token", "connect", "client"],
    "hook": ["://hook"],
    "mysql": ["mysql"],
}
#: Formats of password hashes and of digests with their name, and the digests of nothing.
_DIGEST = re.compile(r"(?i)^(?:\$(?:2[abxy]?|[1567]|y|argon2\w*|pbkdf2[\w-]*|scrypt)\$|\{(?:S?SHA\d*|S?MD5|CRYPT)\}|pbkdf2_\w+\$|(?:sha|md)\d+[:-])")
_EMPTY_DIGESTS = frozenset(hashlib.new(name).hexdigest() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))


def learn_words(texts: list[str], least: int = LEAST_ROWS) -> frozenset[str]:
    """The words of at least four letters that enough of the texts hold."""
    seen: Counter[str] = Counter()
    for text in texts:
        seen.update({word for word in re.findall(r"[a-z]{4,14}", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).lower())})
    return frozenset(word for word, n in seen.items() if n >= least)


class Finder:
    """Finds the credentials of texts, given a dictionary."""

    def __init__(self, words: frozenset[str]) -> None:
        self.words = words | {w for w in (*_NAMES, *_KEY_OF) if len(w) >= 4}
        self.longest = max(map(len, self.words), default=0)
        self.residual = lru_cache(maxsize=100_000)(self._residual)
        self.named = lru_cache(maxsize=100_000)(self._named)
        kinds: dict[str, set[str]] = {}
        for kind, keywords in _KEYWORDS.items():
            for keyword in keywords:
                kinds.setdefault(keyword, set()).add(kind)
        self.keywords = ahocorasick.Automaton()
        for keyword, of in kinds.items():
            self.keywords.add_word(keyword, (len(keyword), tuple(of)))
        self.keywords.make_automaton()

    def _residual(self, literal: str) -> int:
        """How many letters and digits of a literal the best cover by words leaves."""
        low = literal.lower()
        n = len(low)
        best = [0] * (n + 1)
        for end in range(1, n + 1):
            left = best[end - 1] + (1 if low[end - 1].isalnum() else 0)
            for size in range(4, min(self.longest, end) + 1):
                if best[end - size] < left and low[end - size : end] in self.words:
                    left = best[end - size]
            best[end] = left
        return best[n]

    def _value(self, literal: str, *, quoted: bool, least: int = RESIDUAL, strong: bool = False) -> bool:
        """Whether a literal in a credential's place is one; a strong place takes names and short residuals too."""
        if len(literal) < LEAST_CHARS or _PLACEHOLDER.match(literal) or _UUID.match(literal) or _TIME.match(literal):
            return False
        if _DIGEST.match(literal) or literal.lower() in _EMPTY_DIGESTS:
            return False
        digits, letters = sum(c.isdigit() for c in literal), sum(c.isalpha() for c in literal)
        if any(c.isspace() for c in literal):  # a pass phrase: sentences have no numbers that no blank sets apart from letters
            return quoted and least == RESIDUAL and 0 < digits and len(literal.split()) <= PHRASE_WORDS and not _SENTENCE.search(literal) and self.residual(literal) >= RESIDUAL_PHRASE
        if not literal.isascii() and not (digits and any(c.isascii() and c.isalpha() for c in literal)):
            return False
        if _ISSUED.fullmatch(literal):
            return self.residual(literal) >= RESIDUAL
        named = _like_a_name(literal)
        if strong:
            mixed = digits > 0 or (any(c.isupper() for c in literal) and any(c.islower() for c in literal))
            if mixed:
                return digits < len(literal) and not (named and not digits) and self.residual(literal) >= RESIDUAL_STRONG
        if not digits:
            if not (any(c.isupper() for c in literal) and any(c.islower() for c in literal)):
                return (quoted or strong) and letters == len(literal) and least == RESIDUAL and self.residual(literal) >= RESIDUAL_PLAIN
            if named or len(literal) < 8:
                return False
            if not quoted and _CODE.match(literal):
                return False
        elif digits == len(literal):
            return False
        if least == RESIDUAL and digits >= 2 and _BUILT_SHORT.match(literal):
            member = not quoted and re.fullmatch(r"[\w.]+", literal)  # could be a value that code refers to
            return self.residual(literal) >= (RESIDUAL if member else RESIDUAL_STRONG)
        if _PATH.match(literal) and not _mixed(literal):
            return False
        if not quoted and ("(" in literal or re.match(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$|[A-Za-z_]\w*::", literal)) and not _BUILT.match(literal):
            return False
        if named and digits < 3 and len(re.findall(r"\d+", literal)) < 2:
            return False
        return self.residual(literal) >= least

    def _named(self, name: str) -> bool:
        """Whether a name is that of a credential."""
        parts = [p for p in re.split(r"[^a-zà-ÿа-яё一-鿿]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()) if p]
        if not parts or parts[-1] in _NOT_AFTER or parts[0] in _NOT_BEFORE or (len(parts) > 1 and parts[-2] in _NOT_BEFORE):
            return False
        for k, part in enumerate(parts):
            if part in ("key", "keys"):
                if k and parts[k - 1] in _KEY_OF:
                    return True
            elif part in _NAMES or part in _OTHER_NAMES or part.endswith(("password", "passwd", "apikey", "secretkey", "accesskey", "authtoken", "secret", "passphrase", "accountkey")) and part not in ("nosecret",):
                return True
            elif part.endswith("token") and part != "token" or part.endswith("пароль"):
                return True
            elif part.endswith("key") and part[:-3] in _KEY_OF:
                return True
        return False

    def find(self, text: str) -> list[tuple[int, int, int, str]]:
        """(line, begin, end, kind) of each credential of a text, in order; lines count from 1.

        Every place on which a value stands is asked, the more certain kinds first; of places
        that overlap the first one counts. Time is in proportion to the text.
        """
        spans = _Spans(_private_keys(text))
        low = text.lower()
        if len(low) != len(text):
            low = "".join(lc if len(lc := c.lower()) == 1 else c for c in text)
        lines: dict[str, list[tuple[int, int]]] = {}
        issued: list[int] = []
        ends: dict[str, int] = {}
        begin, end = 0, -1
        for last, (size, kinds) in self.keywords.iter(low):
            if last >= end:
                begin = text.rfind("\n", 0, last + 1) + 1
                end = text.find("\n", last)
                end = len(text) if end < 0 else end
            for kind in kinds:
                if kind == "issued":
                    issued.append(last + 1 - size)
                elif ends.get(kind, -1) < end:
                    ends[kind] = end
                    lines.setdefault(kind, []).append((begin, end))
        for at in issued:
            match = _ISSUED.match(text, at)
            if match and not _PLACEHOLDER.match(match[0]) and self.residual(match[0]) >= RESIDUAL and not _BLOB.search(text[max(0, at - 60) : at].rpartition("\n")[2]):
                spans.add(match.start(), match.end(), "issued")
        for kind, keyword, pattern in _SCHEMES:
            for begin, end in lines.get(keyword, ()):
                if kind == "login":  # the parts of a login may stand on lines of their own
                    after = text.find("\n", end + 1)
                    end = len(text) if after < 0 else after
                for match in pattern.finditer(text, begin, end):
                    self._scheme(match, kind, spans)
        for begin, end in lines.get("mysql", ()):
            if first := _MYSQL.search(text, begin, end):
                for match in _MYSQL_FLAG.finditer(text, first.end(), end):
                    self._scheme(match, "flag", spans)
        for begin, end in lines.get("name", ()):
            named = [match.span() for match in _ASSIGNED.finditer(text, begin, end) if self.named(match["name"])]
            for (_, at), (following, _) in zip(named, [*named[1:], (end, end)], strict=False):
                if typed := _TYPED.match(text, at, end):
                    at, following = typed.end(), end
                self._assigned(text, at, end, following, spans)
            after = text.find("\n", end + 1)
            for match in _PAIR.finditer(text, begin, len(text) if after < 0 else after):
                if match.start() < end and self.named(match["name"]):
                    stop = text.find("\n", match.end())
                    stop = len(text) if stop < 0 else stop
                    self._assigned(text, match.end(), stop, stop, spans)
        for begin, end in lines.get("name", ()):
            self._prose(text, begin, end, spans)
        found, line, counted = [], 1, 0
        for begin, end, kind in spans.all():
            line += text.count("\n", counted, begin)
            counted = begin
            found.append((line, begin, end, kind))
        return found

    def _scheme(self, match: re.Match[str], kind: str, spans: _Spans) -> None:
        """The value of a place with a form of its own."""
        value, begin = match["v"], match.start("v")
        if kind == "element":
            value = value.rstrip()
        if kind in ("flag", "login"):
            value = value.rstrip(".,;:)")
        if kind == "hook":
            held = self.residual(value.rpartition("/")[2]) >= RESIDUAL_PROSE
        elif kind == "call":
            held = bool(_CALL.search(match["call"])) and not _HEX.match(value) and self._value(value, quoted=True)
        else:
            held = self._value(value, quoted=True, strong=kind in ("url", "flag", "login", "element"))
        if held:
            spans.add(begin, begin + len(value), kind)

    def _assigned(self, text: str, at: int, end: int, following: int, spans: _Spans) -> None:
        """The value that begins at ``at``, or in the next line that is not blank where nothing else follows.

        A value without quotes ends where the next credential's name begins.
        """
        within = False
        if below := _NEXT.match(text, at):
            within = text[at : at + 1] in "([{" and below.end() > at
            lead = _NEXT_LEAD.match(text, below.end())
            if text.startswith("\\", at):
                lead = re.compile(r"\s*").match(text, below.end())
            at = lead.end()
            end = text.find("\n", at)
            end = following = len(text) if end < 0 else end
            if at >= end:
                return
        at = _OPENED.match(text, at, end).end()
        if quoted := _QUOTED.match(text, at, end):
            group = quoted.lastgroup
            begin, stop, value = quoted.start(group), quoted.end(group), quoted[group].rstrip() if group == "f" else quoted[group]
            if group == "f":
                stop = begin + len(value)
            kind = "assigned"
            while group in "ds":
                joint = (_JOINED.match(text, stop) or (within and _JOINED_LINES.match(text, stop))) or None
                if joint is None:
                    break
                rest = re.compile(r"(?:[^\"'\\\n]|\\.)*").match(text, joint.end())
                kind, value, stop = "joined", value + rest[0], rest.end()
            if self._value(value, quoted=True):
                spans.add(begin, stop, kind)
            return
        if text[at : at + 1] in ('"', "'", "`"):  # never closed
            at += 1
        bare = _BARE.match(text, at, following)
        if not bare:
            return
        stop = bare.end()
        while on := _BARE_ON.match(text, stop, following):
            if not _mixed(on["v"]) or self.residual(on["v"]) < RESIDUAL:
                break
            stop = on.end()
        value = text[at:stop].rstrip(".,;:)")
        if below and text[stop:end].strip(" \t\r,;)"):
            return  # a line of more than a value
        if self._value(value, quoted=False):
            spans.add(at, at + len(value), "assigned")

    def _prose(self, text: str, begin: int, end: int, spans: _Spans) -> None:
        """Literals of running text in a sentence that speaks of a credential; a sentence that ends its line with a colon goes on below."""
        triggers = [t.span() for t in _PROSE.finditer(text, begin, end) if not _OTHER_KEYS.search(text, max(begin, t.start() - 24), t.start())]
        triggers = [t for t in triggers if not spans.named_by(text, t[1]) and not text.startswith("</", max(begin, t[0] - 2))]
        if not triggers:
            return
        stops = [m.start() for m in _APART.finditer(text, begin, end)]
        if text[begin:end].rstrip().endswith((":", "：")) and not any(stop >= triggers[-1][1] for stop in stops):
            below = _NEXT_LEAD.match(text, end).end()
            line_end = text.find("\n", below)
            line_end = len(text) if line_end < 0 else line_end
            chunk = _CHUNK.search(text, below, line_end)
            if chunk and not text[below : chunk.start()].strip("\"'`<([{ \t") and not text[chunk.end() : line_end].strip("\"'`>)]};., \t\r"):
                end = line_end
        starts = [s for s, _ in triggers]
        for match in _CHUNK.finditer(text, begin, end):
            literal = match[0].rstrip(".:?…")
            if literal.startswith("*"):
                literal = literal.strip("*")
            if len(literal) < LEAST_PROSE:
                continue
            here = match.start() + match[0].index(literal)
            after = here + len(literal)
            k = bisect_left(starts, here)
            near = k > 0 and not _between(stops, triggers[k - 1][1], here)
            if not near:
                while k < len(triggers) and triggers[k][1] <= after:  # within the literal itself
                    k += 1
                near = k < len(triggers) and not _between(stops, after, triggers[k][0])
            if not near or not _mixed(literal) or not self._value(literal, quoted=True, least=RESIDUAL if _BUILT.match(literal) else RESIDUAL_PROSE):
                continue
            if re.match(r"(?i)(?:sha|md)\d+[:-]|(?:ssh|ecdsa)-", literal) or "://" in literal or "=" in literal.rstrip("=") or "@" in literal or _PATH.match(literal) and literal.count("/") and "." in literal:
                continue
            if literal.count("/") > 2 and not (len(literal) >= 32 and "." not in literal and self.residual(literal) * 10 >= 6 * len(literal)):
                continue
            before = text[max(begin, here - 60) : here]
            if _BLOB.search(before) or _HASHES.search(before):
                continue
            spans.add(here, after, "prose")


class _Spans:
    """Spans that do not overlap, in order."""

    def __init__(self, first: list[tuple[int, int, str]]) -> None:
        self.begins = [begin for begin, _, _ in first]
        self.rest = [(end, kind) for _, end, kind in first]

    def add(self, begin: int, end: int, kind: str) -> None:
        k = bisect_left(self.begins, end)
        if k and self.rest[k - 1][0] > begin:
            return
        self.begins.insert(k, begin)
        self.rest.insert(k, (end, kind))

    def named_by(self, text: str, at: int) -> bool:
        """Whether a name that ends at ``at`` names the next span."""
        k = bisect_left(self.begins, at)
        return k < len(self.begins) and self.rest[k][1] != "prose" and self.begins[k] - at <= 200 and bool(_USED.fullmatch(text, at, self.begins[k]))

    def all(self) -> list[tuple[int, int, str]]:
        return [(begin, *rest) for begin, rest in zip(self.begins, self.rest, strict=True)]


def _between(stops: list[int], begin: int, end: int) -> bool:
    k = bisect_left(stops, begin)
    return k < len(stops) and stops[k] < end


def _private_keys(text: str) -> list[tuple[int, int, str]]:
    """The private keys of a text, with or without their END line."""
    if "PRIVATE KEY" not in text:
        return []
    found = []
    stops = [m.span() for m in _PEM_END.finditer(text)]
    heads = [m.start() for m in re.finditer("-----BEGIN", text)]
    stop_at = [begin for begin, _ in stops]
    for match in _PEM.finditer(text):
        k, h = bisect_left(stop_at, match.end()), bisect_left(heads, match.end())
        after = heads[h] if h < len(heads) else len(text)
        if k == len(stops) or after < stops[k][0]:
            end = _open_key(text, match.end(), after)
            body = text[match.end() : end]
        else:
            end, body = stops[k][1], text[match.end() : stops[k][0]]
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 32 and not re.search(r"\.\.\.|…|REDACTED|<[a-z -]+>", body):
            found.append((match.start(), end, "private key"))
    return found


def _open_key(text: str, begin: int, limit: int) -> int:
    """Where the body of a private key without an END line ends, at most ``limit``; ``begin`` if there is none."""
    end, lines = begin, 0
    while True:
        at = _KEY_GAP.match(text, end, limit).end()
        if header := _KEY_HEADER.match(text, at, limit):
            end = header.end()
            continue
        line = _KEY_LINE.match(text, at, limit)
        if not line:
            return end if lines else begin
        part = line[0]
        long = len(part) >= 16 and any(c.isupper() for c in part) and any(c.islower() for c in part)
        last = lines and (part.endswith("=") or line.end() == limit or _mixed(part)) and _KEY_LINE_END.match(text, line.end(), limit)
        if not (long or last):
            return end if lines else begin
        end, lines = line.end(), lines + 1


def _like_a_name(literal: str) -> bool:
    """Whether a literal is made of words as names are, of at least 3.5 letters each on average."""
    if not _IDENTIFIER.match(literal):
        return False
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", literal)
    return sum(map(len, parts)) >= 3.5 * len(parts)


def _mixed(literal: str) -> bool:
    """Letters and digits, or letters whose case follows no words."""
    if any(c.isdigit() for c in literal) and any(c.isalpha() for c in literal):
        return True
    return len(re.findall(r"[a-z][A-Z]|[A-Z][a-z](?=[A-Z])|[A-Z]{2,}[a-z]", literal)) >= 3 and not _like_a_name(literal)


def redact(text: str, found: list[tuple[int, int, int, str]]) -> str:
    """The text with each credential masked and all else unchanged; the lines of a private key stay lines."""
    kept, at = [], 0
    for _, begin, end, kind in found:
        if begin < at:
            continue
        kept.append(text[at:begin])
        value = text[begin:end]
        if kind == "private key":
            head, tail = _PEM.match(value), _PEM_END.search(value)
            body = value[head.end() : tail.start() if tail else len(value)]
            kept.append(head[0] + re.sub(r"(\\[rnt])|[A-Za-z0-9+/=:,.-]+", lambda m: m[1] or MASK, body) + (tail[0] if tail else ""))
        elif kind == "joined":
            joints = [m[0] for m in _JOINED_ANY.finditer(value)]
            kept.append(MASK.join(["", *joints, ""]))
        else:
            kept.append(MASK)
        at = end
    return "".join([*kept, text[at:]])


_FINDERS: dict[str, Finder] = {}
FOUND = "struct<redacted:string,found:array<struct<line_no:bigint,begin:bigint,end:bigint,kind:string>>>"


def scanned(text: Column, words: frozenset[str], spark_context) -> Column:  # noqa: ANN001
    """The credentials of a text, and the text without them where there are any."""
    shared = spark_context.broadcast(words)
    number = uuid4().hex

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = _FINDERS.get(number)
        if finder is None:
            _FINDERS.clear()
            finder = _FINDERS[number] = Finder(shared.value)
        for batch in batches:
            redacted, spans = [], []
            for text in batch:
                found = finder.find(text) if text else []
                redacted.append(redact(text, found) if found else None)
                spans.append([{"line_no": line, "begin": b, "end": e, "kind": kind} for line, b, e, kind in found])
            yield pd.DataFrame({"redacted": redacted, "found": spans})

    return scan(text)


def dictionary(texts: DataFrame, key: str, text: str, share: int = SHARE_ROWS) -> frozenset[str]:  # noqa: ARG001
    """The words of at least four letters that one in ``share`` of all rows holds, and at least LEAST_ROWS; repeated rows count again.

    No more than ``share`` times the distinct words of a mean text reach that, whatever the number of rows.
    """
    least = max(LEAST_ROWS, texts.count() // share)
    apart = F.lower(F.regexp_replace(F.col(text), "(?<=[a-z])(?=[A-Z])", " "))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(apart, F.lit("[a-z]{4,14}"), F.lit(0)))).alias("word"))
    return frozenset(row.word for row in words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word").collect())


def find_secrets(df: DataFrame, key: str, text: str, words: frozenset[str]) -> DataFrame:
    """(key, text, flag, redacted, found) of every row.

    ``flag`` is whether the text holds a credential; ``redacted`` is the text with each one
    masked. Null and empty texts hold none and stay as they are. Repeated rows stay repeated.
    """
    scan = scanned(F.col(text), words, df.sparkSession.sparkContext)
    return (
        df.select(F.col(key).alias("row_id"), F.col(text).alias("text"), scan.alias("_s"))
        .select("row_id", "text", (F.size("_s.found") > 0).alias("flag"), F.coalesce("_s.redacted", "text").alias("redacted"), F.col("_s.found").alias("found"))
    )
