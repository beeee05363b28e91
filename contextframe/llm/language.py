"""Languages of documents and of the segments of mixed documents, by a linear-chain CRF.

The words of a document's prose form a chain. A foreign phrase of fewer than SEGMENT_WORDS
words is no segment. The score of a language at a word is the sum
of the weights of the word's features (the word itself, affixes, character n-grams and
script); transitions between neighbouring words have weights too. Both are learned from a
bounded sample of labelled rows. Forward-backward gives each word the probability of each
language; stretches of one language are the segments.

Code, logs, paths and identifiers are no prose: fenced blocks and lines that look like
program text or logs are left out, and so are words that look like identifiers.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages, and the codes that name each one.
LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru", "zh")
CODES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese"),
}
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "mul", "mis", "zxx", "unknown", "none", "null", "n/a", "na", "auto", "other", "xx", "?", "-")

#: Foreign words that make a segment of their own, and words that make a document's only stretch one.
SEGMENT_WORDS, ONLY_WORDS = 8, 4
#: Labelled rows the model is fitted on, and the longest text among them in code points.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 20_000

_CYRILLIC, _HAN = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[㐀-鿿豈-﫿]")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]|['’]?[^\W\d_])*")
_EDGES = ".,;:!?\"'()[]{}«»“”„‘’*`>#|…-–—。，、！？：；（）《》"
#: What makes a chunk a path, call, name or address and not a word of prose.
_NAME = re.compile(r"[\w\])][_/\\\\:@=<>(){}\[\]$&%+~^][\w\[(]|\w\.\w|\d|[a-z][A-Z]|::|_|[{}=$@\\\\<>/]")
_STOP = re.compile(r"[.!?。！？…][\"'»”’)*`\]]*$|^\x00$|[。！？]")
_QUOTED = re.compile(r"`[^`\n]{1,80}`")
_FENCE = re.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.M | re.S)
#: Lines of program text and of logs; only lines that are indented or hold one of _MARKS are asked.
_MARKS = re.compile(r"[(){}\[\]=;]|:[\w\d]|:$|^[ \t>+-]|^compiling |^commit |^index |^ssh-", re.I)
_CODE = re.compile(
    r"""[ \t>+\-|]*(?:
      (?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[\d\d:\d\d:\d\d|\d\d:\d\d:\d\d).*
    | (?:test[ ]\S+::\S+[ ]\.\.\.|compiling[ ]\S+[ ]v\d|\S+:\d+:\d+:[ ]).*
    | (?:@@|diff[ ]--git|index[ ][0-9a-f]{6}|commit[ ][0-9a-f]{7}|sha\d+:|ssh-\w+[ ]|trace_id=|etag:).*
    | (?:def|func|fn|pub|class|struct|impl|let|const|var|return|export|import|from[ ]\S+[ ]import|if|for|while|else|elif|try|except|switch|case|async|await|assert\w*!?|self\.|this\.|use|package|public|private|static|void|select|insert|update|delete|create)\b(?=.*[({;=\[<>]).*[;:{}()\]]
    | (?:if|elif|while)[ ]\S+[ ](?:[<>]=?|[=!]=|in|is)[ ].*:
    | for[ ]\w+[ ]in[ ].*:
    | return(?:[ ]+[\w."'\[\]]+)?
    | (?:else|try|finally)[ ]?:
    | .*[;{}]
    | [}\])]+.*
    | [\w.\[\]"']+[ ]*(?:=|\+=|-=|:=|<-)[ ].*
    | [\w.]+(?:,[ ]\w+)*[ ]:?=[ ].*
    | [\w.]+\(.*\)
    )[ \t\r,]*""",
    re.X | re.I,
)


def named(label: str | None) -> str | None:
    """The language that a label names: a code of LANGUAGES, another code, or None."""
    text = (label or "").strip().lower()
    if text in NO_LANGUAGE:
        return None
    first = re.split(r"[-_ ]", text)[0]
    return next((code for code, names in CODES.items() if first in names), first)


def prose(text: str) -> str:
    """The text without its lines of code and logs; a blank line becomes a chunk of its own that ends a sentence."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text:
        text = _QUOTED.sub(" ", text)
    marks, code = _MARKS.search, _CODE.fullmatch
    return "\n".join(["\x00" if not line or marks(line) and code(line) else line for line in text.split("\n")])


def words_of(chunk: str) -> tuple[list[str], int, bool]:
    """Of a piece of text without white space: its words in lower case, how many words it counts for, and whether a sentence ends with it."""
    stop = bool(_STOP.search(chunk))
    if _HAN.search(chunk):
        found = _HAN.findall(chunk)
        return found, (len(found) + 1) // 2, stop
    inner = chunk.strip(_EDGES)
    if not inner or not _WORD.search(inner):
        return [], 0, stop
    if _NAME.search(inner):
        return [], 1, stop
    found = [word.lower() for word in _WORD.findall(inner)]
    return found, len(found), stop


_FOLD: dict[str, str] = {}


def folded(word: str) -> str:
    """The word in lower case without accents."""
    known = _FOLD.get(word)
    if known is None:
        if len(_FOLD) > 500_000:
            _FOLD.clear()
        low = word.lower()
        known = low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)).replace("ß", "ss")
        _FOLD[word] = known
    return known


def features(word: str) -> list[str]:
    """Of a word in lower case: script, word, affixes and n-grams without accents, and accented letters."""
    if _HAN.match(word):
        return ["#han"]
    plain = folded(word)
    if _CYRILLIC.match(word):
        return ["#cyrillic", "w" + plain]
    edged = f"<{plain}>"
    found = ["#latin", "w" + plain]
    found += ["p" + plain[:k] for k in (1, 2, 3) if len(plain) > k]
    found += ["s" + plain[-k:] for k in (1, 2, 3, 4) if len(plain) > k]
    found += ["g" + edged[k : k + 3] for k in range(len(edged) - 2)]
    found += ["a" + c for c in {*word} if not c.isascii()]
    return found


class Model:
    """Weights of features and transitions; no larger than the sample's features, so small enough to broadcast."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> None:
        self.index, self.weights, self.transitions, self.start = index, weights, transitions, start

    def save(self, path: str | Path) -> None:
        """Writes the model to a file, so that later runs need not fit it again."""
        np.savez_compressed(path, names=np.array(list(self.index), object).astype(str), weights=self.weights, transitions=self.transitions, start=self.start)

    @classmethod
    def load(cls, path: str | Path) -> Model:
        """The model of a file that :meth:`save` wrote."""
        with np.load(path) as held:
            return cls({name: k for k, name in enumerate(held["names"].tolist())}, held["weights"], held["transitions"], held["start"])

    def emissions(self, words: list[str]) -> np.ndarray:
        """The scores of words in lower case."""
        found = [[k for f in features(word) if (k := self.index.get(f)) is not None] for word in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((k for ks in found for k in ks), np.int64, int(sizes.sum()))
        scores = np.zeros((len(words), len(LANGUAGES)), np.float32)
        if len(flat):
            some = np.flatnonzero(sizes)
            begins = (np.cumsum(sizes) - sizes)[some]
            scores[some] = np.add.reduceat(self.weights[flat], begins, axis=0)
        return scores


def forward_backward(scores: np.ndarray, fresh: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The probabilities of all words of many chains; rows of ``scores`` are ordered by step, longer chains first.

    ``sizes`` is the number of chains that have each step. ``fresh`` marks the words that
    begin a sentence, which have transitions of their own.
    """
    potential = np.exp(scores - scores.max(1, keepdims=True))
    inside, across = np.exp(transitions)
    ahead = np.empty_like(potential)
    stops = np.cumsum(sizes).tolist()
    sizes = sizes.tolist()
    fresh = fresh[:, None]
    row = potential[: sizes[0]] * np.exp(start)
    ahead[: sizes[0]] = row = row / row.sum(1, keepdims=True)
    for t in range(1, len(sizes)):
        here = slice(stops[t] - sizes[t], stops[t])
        row = row[: sizes[t]]
        row = np.where(fresh[here], row @ across, row @ inside) * potential[here]
        row /= row.sum(1, keepdims=True)
        ahead[here] = row
    back = np.ones((sizes[-1], scores.shape[1]), potential.dtype)
    inside, across = inside.T.copy(), across.T.copy()
    for t in range(len(sizes) - 1, 0, -1):
        here = slice(stops[t] - sizes[t], stops[t])
        step = back * potential[here]
        ahead[here] *= back
        step = np.where(fresh[here], step @ across, step @ inside)
        step /= step.sum(1, keepdims=True)
        if sizes[t - 1] > sizes[t]:
            back = np.ones((sizes[t - 1], scores.shape[1]), potential.dtype)
            back[: sizes[t]] = step
        else:
            back = step
    ahead[: sizes[0]] *= back
    return ahead / ahead.sum(1, keepdims=True)


def _sentences(rows: list[tuple[str, str]]) -> list[tuple[int, list[str]]]:
    """(language, words) of sentences, without those that speak against their row's label."""
    found: list[tuple[int, list[str]]] = []
    for text, label in rows:
        sentence: list[str] = []
        for chunk in [*prose(text).split(), "\x00"]:
            words, _, stop = words_of(chunk)
            sentence += words
            if stop:
                if len(sentence) >= 4:
                    found.append((LANGUAGES.index(label), sentence))
                sentence = []
    counts = [Counter() for _ in LANGUAGES]
    for label, words in found:
        counts[label].update(words)
    vocabulary = {word: k for k, word in enumerate(dict.fromkeys(word for _, words in found for word in words))}
    logs = np.empty((len(vocabulary), len(LANGUAGES)))
    for label, of in enumerate(counts):
        logs[:, label] = np.log((np.array([of.get(word, 0) for word in vocabulary]) + 0.1) / (of.total() + 1e4))
    return [(label, words) for label, words in found if logs[[vocabulary[word] for word in words]].sum(0).argmax() == label]


def fit(rows: list[tuple[str, str]], *, steps: int = 400, length: int = 40, batch: int = 64, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> Model:
    """A model fitted to (text, language) rows by gradient ascent on the chains' log-likelihood.

    Chains are made of sentences of one language, one in three of which switches the
    language and one in twenty does so halfway, so that transitions are learned too. One
    sentence in four is read without accents.
    """
    rng = np.random.default_rng(seed)
    labels_n = len(LANGUAGES)
    flat = _sentences([row for row in rows if row[1] in LANGUAGES])
    if not flat:
        return Model({}, np.zeros((1, labels_n), np.float32), np.zeros((2, labels_n, labels_n), np.float32), np.zeros(labels_n, np.float32))
    often = Counter(word for _, words in flat for word in words)
    vocabulary = {word: k for k, word in enumerate(dict.fromkeys([*often, *(folded(word) for word in often)]))}
    named_features = [features(word) for word in vocabulary]
    seen: Counter[str] = Counter()
    for word, of in zip(vocabulary, named_features, strict=True):
        seen.update(dict.fromkeys(of, often.get(word, 0)))
    index = {f: k for k, f in enumerate(f for f, n in seen.items() if n > 2)}
    lists = [[index[f] for f in of if f in index] for of in named_features]
    width = max(map(len, lists))
    table = np.full((len(lists), width), len(index), np.int64)
    for k, of in enumerate(lists):
        table[k, : len(of)] = of
    exact = [np.array([vocabulary[word] for word in words]) for _, words in flat]
    plain = [np.array([vocabulary[folded(word)] for word in words]) for _, words in flat]
    groups = {label: [k for k, (of, _) in enumerate(flat) if of == label] for label in sorted({label for label, _ in flat})}
    labels = list(groups)
    weights = np.zeros((len(index) + 1, labels_n))
    moves, start = np.zeros((2, labels_n, labels_n)), np.zeros(labels_n)
    squares, m_squares, s_squares = np.full(weights.shape, 1e-2), np.full(moves.shape, 1e-2), np.full(start.shape, 1e-2)
    unit = np.eye(labels_n)
    shape = (length, batch, labels_n)
    column = np.arange(labels_n)
    for _ in range(steps):
        tokens, truth, fresh = np.zeros((length, batch), np.int64), np.zeros((length, batch), np.int64), np.zeros((length, batch), bool)
        for b in range(batch):
            chain, said, begins, size = [], [], [], 0
            label = labels[rng.integers(len(labels))]
            skip = int(rng.integers(12))
            while size < length + skip:
                k = groups[label][rng.integers(len(groups[label]))]
                words = (plain if rng.random() < 0.25 else exact)[k]
                if rng.random() < 0.05:
                    words = words[: len(words) // 2 + 1]
                begin = np.zeros(len(words), bool)
                begin[0] = True
                chain.append(words)
                said.append(np.full(len(words), label))
                begins.append(begin)
                size += len(words)
                if len(words) == len(exact[k]) and rng.random() < 0.33 or len(words) < len(exact[k]):
                    label = labels[rng.integers(len(labels))]
                    if len(words) < len(exact[k]):  # the next one goes on within the sentence
                        k = groups[label][rng.integers(len(groups[label]))]
                        chain.append(exact[k])
                        said.append(np.full(len(exact[k]), label))
                        begins.append(np.zeros(len(exact[k]), bool))
                        size += len(exact[k])
            tokens[:, b], truth[:, b], fresh[:, b] = (np.concatenate(x)[skip : skip + length] for x in (chain, said, begins))
        distinct, where = np.unique(tokens.ravel(), return_inverse=True)
        scores = weights[table[distinct]].sum(1)[where]
        potential = np.exp(scores - scores.max(1, keepdims=True)).reshape(shape)
        move = np.exp(moves)
        ahead, back = np.empty(shape), np.ones(shape)
        ahead[0] = potential[0] * np.exp(start)
        ahead[0] /= ahead[0].sum(1, keepdims=True)
        for t in range(1, length):
            here = np.where(fresh[t][:, None], ahead[t - 1] @ move[1], ahead[t - 1] @ move[0]) * potential[t]
            ahead[t] = here / here.sum(1, keepdims=True)
        for t in range(length - 1, 0, -1):
            here = back[t] * potential[t]
            here = np.where(fresh[t][:, None], here @ move[1].T, here @ move[0].T)
            back[t - 1] = here / here.sum(1, keepdims=True)
        single = ahead * back
        single /= single.sum(2, keepdims=True)
        later = potential[1:] * back[1:]
        slope = np.zeros(moves.shape)
        for kind in (0, 1):
            own = fresh[1:] == bool(kind)
            lead, follow = ahead[:-1][own], later[own]
            scale = 1 / np.einsum("na,ab,nb->n", lead, move[kind], follow)
            slope[kind] = np.bincount(truth[:-1][own] * labels_n + truth[1:][own], minlength=labels_n**2).reshape(labels_n, labels_n) - (lead * scale[:, None]).T @ follow * move[kind]
        slope -= decay * moves * batch
        m_squares += slope**2
        moves += rate * slope / np.sqrt(m_squares)
        by_word = np.stack([np.bincount(where, (unit[truth] - single)[:, :, label].ravel(), len(distinct)) for label in range(labels_n)], 1)
        used, spot = np.unique(table[distinct].ravel(), return_inverse=True)
        spread = np.repeat(by_word, width, axis=0)
        slope = np.bincount((spot[:, None] * labels_n + column).ravel(), spread.ravel(), len(used) * labels_n).reshape(-1, labels_n)
        slope[used == len(index)] = 0
        slope -= decay * weights[used] * batch
        squares[used] += slope**2
        weights[used] += rate * slope / np.sqrt(squares[used])
        slope = (unit[truth[0]] - single[0]).sum(0)
        s_squares += slope**2
        start += rate * slope / np.sqrt(s_squares)
    return Model(index, weights.astype(np.float32), moves.astype(np.float32), start.astype(np.float32))


class Tagger:
    """Segments of many documents at a time, with what is known of chunks seen before kept."""

    KEPT_CHUNKS = 400_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.scores = np.empty((0, len(LANGUAGES)), np.float32)
        self.flat, self.begin, self.size, self.count = (np.empty(0, np.int64) for _ in range(4))
        self.stop = np.empty(0, bool)

    def _learn(self, chunks: list[str]) -> None:
        if len(self.chunks) > self.KEPT_CHUNKS:
            self.forget()
        new = list(set(chunks).difference(self.chunks))
        if not new:
            return
        found = [words_of(chunk) for chunk in new]
        fresh = list(dict.fromkeys(word for words, _, _ in found for word in words if word not in self.words))
        self.scores = np.concatenate([self.scores, self.model.emissions(fresh)])
        self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
        sizes = np.fromiter((len(words) for words, _, _ in found), np.int64, len(found))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.fromiter((self.words[word] for words, _, _ in found for word in words), np.int64, int(sizes.sum()))])
        self.size = np.concatenate([self.size, sizes])
        self.count = np.concatenate([self.count, np.fromiter((count for _, count, _ in found), np.int64, len(found))])
        self.stop = np.concatenate([self.stop, np.fromiter((stop for _, _, stop in found), bool, len(found))])
        self.chunks.update(zip(new, range(len(self.chunks), len(self.chunks) + len(new)), strict=True))

    def segments(self, texts: list[str]) -> list[list[tuple[str, int, int, int, float]]]:
        """(language, first chunk, chunk after the last, words, confidence) of each segment of each text.

        Chunks are the pieces between white space of ``prose(text)``, numbered from 0.
        """
        result: list[list[tuple[str, int, int, int, float]]] = [[] for _ in texts]
        chunks: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = prose(text).split()
            per_text[k] = len(found)
            chunks += found
        if not chunks:
            return result
        self._learn(chunks)
        which = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        sizes = self.size[which]
        total = int(sizes.sum())
        if not total:
            return result
        ends = np.cumsum(sizes)
        numbers = self.flat[np.repeat(self.begin[which] - (ends - sizes), sizes) + np.arange(total)]
        chunk_of = np.repeat(np.arange(len(which)), sizes)
        text_begin = np.cumsum(per_text) - per_text
        text_of = np.repeat(np.arange(len(texts)), per_text)[chunk_of]
        counted = np.concatenate([[0], np.cumsum(self.count[which])])
        stops = np.concatenate([[0], np.cumsum(self.stop[which])])
        begins = np.ones(total, bool)  # the first word of a text or sentence
        begins[1:] = (stops[chunk_of[1:]] != stops[chunk_of[:-1]]) | (text_of[1:] != text_of[:-1])
        lengths = np.bincount(text_of, minlength=len(texts))
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        long = lengths[order]
        step = np.arange(total) - np.repeat(np.cumsum(long) - long, long)
        source = np.repeat(starts[order], long) + step
        packed = source[np.argsort(step.astype(np.int32), kind="stable")]
        chances = np.empty((total, len(LANGUAGES)), np.float32)
        chances[packed] = forward_backward(self.scores[numbers[packed]], begins[packed], np.bincount(step), self.model.transitions, self.model.start)
        best = chances.argmax(1)
        sure = chances[np.arange(total), best]
        breaks = np.ones(total, bool)
        breaks[1:] = (best[1:] != best[:-1]) | (text_of[1:] != text_of[:-1])
        run_begin = np.flatnonzero(breaks)
        run_end = np.append(run_begin[1:], total)
        sums = np.add.reduceat(sure, run_begin)
        first, last = chunk_of[run_begin], chunk_of[run_end - 1]
        counts = counted[last + 1] - counted[first]
        runs: dict[int, list[list]] = defaultdict(list)
        for k, label, begin, end, count, score, n in zip(*(x.tolist() for x in (text_of[run_begin], best[run_begin], first, last, counts, sums, run_end - run_begin)), strict=True):
            base = int(text_begin[k])
            runs[k].append([label, begin - base, end + 1 - base, count, score, n])
        for k, of in runs.items():
            result[k] = [(LANGUAGES[label], begin, end, count, score / n) for label, begin, end, count, score, n in joined(of)]
        return result


def joined(runs: list[list]) -> list[list]:
    """Runs of a document made into segments: short foreign ones end nothing, whatever the confidence.

    Runs of one language with only short ones between them are merged before their words are
    counted. A document whose stretches are all short has one segment, of the language of
    most of its words, if there are ONLY_WORDS of them.
    """
    if kept := _merged(_kept(runs)):
        return kept
    total: Counter[int] = Counter()
    for run in runs:
        total[run[0]] += run[3]
    label, count = total.most_common(1)[0]
    return _merged([run for run in runs if run[0] == label]) if count >= ONLY_WORDS else []


def _kept(runs: list[list]) -> list[list]:
    """The runs without the short ones to pass over, so that every merged stretch has SEGMENT_WORDS and the most words are in one."""
    if all(run[3] >= SEGMENT_WORDS for run in runs):
        return runs
    # (language, words of its stretch so far) -> (words in stretches, stretches, counted down, runs kept, the last one first)
    states: dict[tuple, tuple] = {(None, SEGMENT_WORDS): (0, 0, None)}
    for run in runs:
        after = dict(states) if run[3] < SEGMENT_WORDS else {}
        for (label, n), (words, stretches, chain) in states.items():
            if label == run[0]:
                state, value = (label, min(SEGMENT_WORDS, n + run[3])), (words + run[3], stretches, (run, chain))
            elif n >= SEGMENT_WORDS:
                state, value = (run[0], min(SEGMENT_WORDS, run[3])), (words + run[3], stretches - 1, (run, chain))
            else:
                continue
            if state not in after or value[:2] > after[state][:2]:
                after[state] = value
        states = after
    chain = max((value for (_, n), value in states.items() if n >= SEGMENT_WORDS), key=lambda value: value[:2])[2]
    kept = []
    while chain:
        kept.append(chain[0])
        chain = chain[1]
    return kept[::-1]


def _merged(runs: list[list]) -> list[list]:
    """Neighbours of one language made one, with the words, probabilities and counts of its own runs."""
    merged: list[list] = []
    for run in runs:
        if merged and merged[-1][0] == run[0]:
            merged[-1][2] = run[2]
            for k in (3, 4, 5):
                merged[-1][k] += run[k]
        else:
            merged.append(list(run))
    return merged


def passage(text: str, begin: int, end: int) -> str:
    """The prose of chunks ``begin`` to ``end``."""
    return " ".join(chunk for chunk in prose(text).split()[begin:end] if chunk != "\x00")


_TAGGERS: dict[str, Tagger] = {}
SLICE_CHARS = 1_000_000


def label_known(lang: Column) -> Column:
    """The code of LANGUAGES that a label names, else null."""
    first = F.lower(F.split(F.trim(lang), "[-_ ]")[0])
    known = F.create_map(*[F.lit(x) for code, names in CODES.items() for name in names for x in (name, code)])
    return F.try_element_at(known, first)


def sample(documents: DataFrame, text: str, lang: str, key: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """About ``rows`` labelled texts, and never more than twice as many, spread over all documents by a hash of the key."""
    total = max(1, documents.count())
    share = min(1.0, 1.6 * rows / total)  # about a third has no usable label
    chosen = documents.select(F.col(text).alias("t"), label_known(F.col(lang)).alias("l")).where(
        (F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000)))) & F.col("l").isNotNull() & (F.length("t") <= SAMPLE_CHARS)
    )
    return sorted((row.t, row.l) for row in chosen.limit(2 * rows).collect())


def fitted(documents: DataFrame, text: str, lang: str, key: str, path: str | Path | None = None) -> Model:
    """The model of ``path``, or one fitted to a sample of the documents, which is then kept there if a path is given."""
    if path is not None and Path(path).exists():
        return Model.load(path)
    model = fit(sample(documents, text, lang, key))
    if path is not None:
        model.save(path)
    return model


def find_segments(documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(key, label, segments, seg_no, lang, first_chunk, end_chunk, words, confidence): a row for each segment of each document.

    Null and empty texts and texts without prose have no rows. Rows with the same key are
    read each on its own. Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    number = uuid4().hex
    names = ["label", "segments", "seg_no", "lang", "first_chunk", "end_chunk", "words", "confidence"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _TAGGERS.get(number)
        if tagger is None:
            _TAGGERS.clear()
            tagger = _TAGGERS[number] = Tagger(shared.value)
        for batch in batches:
            keys, texts, labels = (batch.column(k).to_pylist() for k in range(3))
            kept = [k for k, value in enumerate(texts) if value]
            at = 0
            while at < len(kept):
                end, chars = at, 0
                while end < len(kept) and (end == at or chars + len(texts[kept[end]]) < SLICE_CHARS):
                    chars += len(texts[kept[end]])
                    end += 1
                part = kept[at:end]
                rows = [
                    (keys[k], labels[k], len(found), no, *segment)
                    for k, found in zip(part, tagger.segments([texts[k] for k in part]), strict=True)
                    for no, segment in enumerate(found, 1)
                ]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, *kinds], strict=True)], [key, *names])
                at = end

    kind = documents.schema[key].dataType.simpleString()
    chosen = documents.select(F.col(key), F.col(text), (F.col(lang) if lang else F.lit(None)).cast("string").alias("_label"))
    return chosen.mapInArrow(tagged, f"`{key}` {kind}, label string, segments bigint, seg_no bigint, lang string, first_chunk bigint, end_chunk bigint, words bigint, confidence double")


def is_case() -> Column:
    """Two or more segments, or one whose document has no label or one that names another language."""
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    return (F.col("segments") > 1) | label.isin(*NO_LANGUAGE) | ~label_known(F.col("label")).eqNullSafe(F.col("lang"))
