"""Toxicity scoring of deobfuscated text.

A word that may be disguised (digits and signs for letters, letters spaced out, doubled or repeated) becomes a
lattice of the characters it may stand for, and Viterbi decoding under a character trigram model of the
corpus picks the likeliest reading. The restored text is scored by logistic regression on the words and word beginnings
that are commoner in toxic documents than in others.

The trigram model is counted over all documents. Markers and their weights are fitted on at most FIT_ROWS
labelled documents, and all clear markers of these are kept; everything else covers all data.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialise, text_of

#: Labelled documents that markers are counted over at most; more are sampled by a hash of the identifier.
FIT_ROWS = 20_000
#: Lengths of word beginnings that can be markers besides whole words.
BEGINNINGS = (3, 4, 5, 6)
#: Standard errors by which a marker is commoner in toxic documents, and toxic documents that have it at least.
CLEAR, LEAST_DOCS = 3.3, 3
#: Weight of the squares in the regression, its steps at most, and the change of a weight at which it ends.
RIDGE, STEPS, SETTLED = 1.0, 400, 1e-5
THRESHOLD = 0.7
#: Tokens whose readings a task remembers before it starts afresh, and bytes of text that are scored at once.
MEMO_TOKENS, SLICE_BYTES = 100_000, 4 << 20
#: Letters of a spaced-out word at most: each start and each end in a run of single characters is read over so many.
SPACED_LETTERS = 24
#: Letters the trigram model knows: a-z and the lower-case Latin letters with marks.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
#: What a sign may stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = "._-*~'`^/\\,"
#: Signs that also end or part words; dropping one is likelier than dropping another sign.
PUNCTUATION = "!|+(<"
#: Costs in nats: reading a sign as a letter; dropping one letter of a run of three or more, or of two; dropping a separator,
#: punctuation, or any other sign.
SIGN_COST, RUN_COST, PAIR_COST, SEPARATOR_COST, PUNCTUATION_COST, DROP_COST = 1.0, 0.3, 4.0, 0.2, 3.0, 9.0
#: Costs of a letter that the model does not know (only repeats of it are dropped), and of a digit or another sign that stands
#: for itself in a word without letters (a separator costs the same either way).
FOREIGN_COST, DIGIT_COST, PLAIN_COST = 2.0, 4.0, 6.0

_PARTED = "[" + re.escape(SEPARATORS) + "\\s]+"
_SINGLE = "[^" + re.escape(SEPARATORS) + "\\s]"
_RUN = "[\"'(\\[{<]*((?:" + _SINGLE + _PARTED + "){2,}" + _SINGLE + ")[\"')\\]}>.,;:!?&%#*]*"
_SPACED = "(?:^|\\s)" + _RUN + "(?:\\s|$)"
_SPACED_RUN = re.compile("(?<!\\S)" + _RUN + "(?!\\S)")
_PARTS = re.compile(_PARTED)
_DISGUISE = re.compile("[" + re.escape("".join(LEET)) + "._*~^-]|(.)\\1\\1")
_DOUBLED = re.compile(r"(.)\1")
_OUTER = re.compile(r"^[\"'(\[{<.,;:]+|[\"')\]}>.,;:!?&%#*]+$")
_LETTER = re.compile(r"[^\W\d_]")
_UNKNOWN = "\0"


class Trigrams:
    """Log probability of a letter after two others, with shorter contexts mixed in; ^ and $ mark a word's ends."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.three, self.two, self.one = Counter(counts), Counter(), Counter()
        for gram, n in counts.items():
            self.two[gram[1:]] += n
            self.one[gram[2]] += n
        self.after_two, self.after_one = Counter(), Counter()
        for gram, n in counts.items():
            self.after_two[gram[:2]] += n
            self.after_one[gram[1]] += n
        self.total, self.memo = sum(self.one.values()), {}
        self.spread = self._spread()

    def _log(self, context: str, letter: str) -> float:
        key = context + letter
        p = (self.one[letter] + 0.5) / (self.total + 0.5 * (len(LETTERS) + 2))
        p = (self.two[key[1:]] + 5 * p) / (self.after_one[context[1]] + 5)
        return math.log((self.three[key] + 5 * p) / (self.after_two[context] + 5))

    def __call__(self, context: str, letter: str) -> float:
        key = context + letter
        if key not in self.memo:
            self.memo[key] = self._log(context, letter)
        return self.memo[key]

    def _spread(self) -> float:
        """The most by which the costs of one reading can differ after two contexts: the next letter sees two other
        letters before it, the one after that another letter two places before it, and further ones no difference."""
        first = [*LETTERS, "^", _UNKNOWN]
        far, near = 0.0, 0.0
        for letter in [*LETTERS, "$"]:
            by_last = [[self._log(a + b, letter) for a in first] for b in first]
            far = max(far, max(map(max, by_last)) - min(map(min, by_last)))
            near = max(near, *[max(x) - min(x) for x in by_last])
        return far + near


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each character the letters it may stand for (or none) with the cost of that reading."""
    out: list[list[tuple[str, float]]] = []
    foreign = False
    for i, c in enumerate(word):
        if unicodedata.category(c)[0] != "M":  # a mark goes with its letter
            foreign = c.isalpha() and c not in LETTERS
        if c in LETTERS:
            readings = [(c, 0.0)]
        elif c in LEET:
            readings = [*[(x, SIGN_COST) for x in LEET[c]], ("", PUNCTUATION_COST if c in PUNCTUATION else DROP_COST)]
        elif foreign:
            readings = [(c, FOREIGN_COST)]
        else:
            readings = [("", SEPARATOR_COST if c in SEPARATORS else DROP_COST)]
        if i and word[i - 1] == c:
            readings = [*readings, ("", RUN_COST if c * 3 in word[max(0, i - 2) : i + 3] else PAIR_COST)]
        out.append(readings)
    return out


def decode(word: str, model: Trigrams) -> str:
    """The likeliest reading of a lower-case word; one without letters may also stand for itself.

    Viterbi decoding: for each two last letters the cheapest reading so far. A state that costs more than the cheapest
    one by model.spread cannot end cheaper, whatever follows, and is dropped, so long words take few states.
    """
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for readings in lattice(word):
        after: dict[str, tuple[float, tuple | None]] = {}
        for context, (cost, said) in best.items():
            for letter, own in readings:
                if not letter:
                    state, c = context, cost + own
                elif letter in LETTERS:
                    state, c = context[1] + letter, cost + own - model(context, letter)
                else:
                    state, c = context[1] + _UNKNOWN, cost + own
                if state not in after or c < after[state][0]:
                    after[state] = (c, (letter, said) if letter else said)
        if len(after) > 4:
            most = min([c for c, _ in after.values()]) + model.spread
            after = {state: x for state, x in after.items() if x[0] <= most}
        best = after
    cost, path = min(((cost - model(context, "$"), said) for context, (cost, said) in best.items()), key=lambda x: x[0])
    letters = []
    while path:
        letters.append(path[0])
        path = path[1]
    said = "".join(reversed(letters))
    if not _LETTER.search(word) and sum(DIGIT_COST if c.isdigit() else SEPARATOR_COST if c in SEPARATORS else PLAIN_COST for c in word) <= cost:
        return word
    return said


def restore(token: str, model: Trigrams) -> str:
    """The word of a token: without outer punctuation, in lower case, and decoded if it may be disguised."""
    word = token.lower()
    if not word.isalpha():
        bare = _OUTER.sub("", word)
        word = bare if bare.isalpha() else _OUTER.sub("", bare, count=1) if bare[:1] in "\"'([{<" else bare
    if _DISGUISE.search(word):
        return decode(word, model)
    return word


def features(word: str) -> list[str]:
    """The word between ^ and $, and its beginnings after ^."""
    if len(word) < 3:
        return []
    return [f"^{word}$", *[f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


def token_features(token: str, model: Trigrams) -> list[str]:
    """Features of the restored word and, as a doubled letter may be spelling or disguise, of its likeliest reading besides."""
    word = restore(token, model)
    found = features(word)
    if _DOUBLED.search(word) and word.isalpha() and (other := decode(word, model)) != word:
        return list(dict.fromkeys([*found, *features(other)]))
    return found


def first_letters(word: str) -> list[str]:
    """All that readings of a word without signs may begin with, in three letters: of a run of letters one or more stay."""
    found, runs = [""], 0
    for run in re.finditer(r"(.)\1*", word):
        found = [p + run[1] * k for p in found for k in (range(1, min(len(run[0]), 3 - len(p)) + 1) if len(p) < 3 else (0,))]
        runs += 1
        if runs == 3:
            break
    return found


def _spaced_words(text: str, model: Trigrams) -> list[str]:
    """Readings of runs of three or more single characters. Other single characters may stand before and after a word, so
    each start and each end in a run counts, over SPACED_LETTERS letters. Runs without blanks are tokens, which are read as such."""
    found = []
    for run in _SPACED_RUN.findall(text):
        if len(run.split()) > 1:
            letters = _PARTS.sub("", run).lower()
            found += [decode(letters[i : i + SPACED_LETTERS], model) for i in range(max(1, len(letters) - 2))]
            found += [decode(letters[max(0, i - SPACED_LETTERS) : i], model) for i in range(3, len(letters))]
    return found


def _token_lists(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, the index of each token in turn, and where each text's tokens end."""
    words = pc.utf8_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    offsets = words.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets[1:] - offsets[0]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def character_model(docs: DataFrame, text_col: str = "text") -> Trigrams:
    """Trigram counts over the plain words of all documents. The result is bounded by the alphabet, not by the corpus."""
    alphabet = "^$" + LETTERS
    place = np.zeros(max(map(ord, alphabet)) + 1, np.int64)
    place[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    plain = f"^[{LETTERS}]+$"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(64**3, np.int64)
        for batch in batches:
            for part in _slices(batch, "text"):
                words = pc.utf8_split_whitespace(part.column("text")).flatten().value_counts()
                lower = pc.utf8_rtrim(pc.utf8_lower(words.field("values")), ".,")
                known = pc.match_substring_regex(lower, plain)
                lower, times = lower.filter(known), words.field("counts").filter(known).to_numpy()
                if not len(lower):
                    continue
                codes = place[np.frombuffer(("^^" + "$^^".join(lower.to_pylist()) + "$").encode("utf-32-le"), np.uint32)]
                times = np.repeat(times, pc.utf8_length(lower).to_numpy() + 3)
                inside = (codes[:-2] != 1) & (codes[1:-1] != 1)  # a word's end comes last
                keys = (codes[:-2] * 64 + codes[1:-1]) * 64 + codes[2:]
                found += np.bincount(keys[inside], times[:-2][inside], minlength=64**3).astype(np.int64)
        some = np.flatnonzero(found)
        grams = [alphabet[k >> 12] + alphabet[k >> 6 & 63] + alphabet[k & 63] for k in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(found[some], pa.int64())], names=["gram", "n"])

    grams = docs.select(text_of(text_col).alias("text")).mapInArrow(giving_back(count), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return Trigrams({r["gram"]: r["n"] for r in grams.collect()})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 3 == 1


class Markers:
    """What a task needs to score texts: the trigram model, each marker's number, and the regression's weights."""

    def __init__(self, letters: Trigrams, number: dict[str, int]) -> None:
        self.letters, self.number = letters, number
        self.starts = {f[1:4] for f in number}
        self.weights, self.bias = np.zeros(2 * len(number)), 0.0
        self.memo: dict[str, tuple[int, ...]] = {}

    def marks(self, token: str) -> tuple[int, ...]:
        found = self.memo.get(token)
        if found is None:
            found = self.memo[token] = self._marks(token)
        return found

    def _marks(self, token: str) -> tuple[int, ...]:
        """numbers(token_features(token)), without what cannot begin like a marker."""
        word = restore(token, self.letters)
        found = features(word) if word[:3] in self.starts else []
        if _DOUBLED.search(word) and word.isalpha() and any(x in self.starts for x in first_letters(word)) and (other := decode(word, self.letters)) != word:
            found = list(dict.fromkeys([*found, *features(other)]))
        return self.numbers(found)

    def numbers(self, found: list[str]) -> tuple[int, ...]:
        return tuple([self.number[f] for f in found if f in self.number])

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, marker and number of finds for all that occur, and the words of each document."""
        tokens, index, ends = _token_lists(texts)
        if len(self.memo) > MEMO_TOKENS:
            self.memo.clear()
        marks = [self.marks(t) for t in tokens]
        n = np.array([len(m) for m in marks] + [0])
        flat, first = np.array([k for m in marks for k in m], dtype=np.int64), np.concatenate([[0], np.cumsum(n)])
        at = np.flatnonzero(n[index]) if len(index) else np.zeros(0, np.int64)
        mine = index[at]
        key = flat[np.arange(n[mine].sum()) + np.repeat(first[mine] - (np.cumsum(n[mine]) - n[mine]), n[mine])] if len(at) else np.zeros(0, np.int64)
        doc = np.repeat(np.searchsorted(ends, at, "right"), n[mine])
        spaced = pc.fill_null(pc.match_substring_regex(texts, _SPACED), False).to_numpy(zero_copy_only=False)
        more = [(int(k), m) for k in np.flatnonzero(spaced) for w in _spaced_words(texts[int(k)].as_py(), self.letters) for m in self.numbers(features(w))]
        pairs = np.concatenate([doc, [d for d, _ in more]]).astype(np.int64) * max(1, len(self.number)) + np.concatenate([key, [m for _, m in more]]).astype(np.int64)
        pairs, times = np.unique(pairs, return_counts=True)
        size = max(1, len(self.number))
        return pairs // size, pairs % size, times, np.diff(np.concatenate([[0], ends]))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        doc, marker, times, words = self.counts(texts)
        often, share = _values(times, words[doc])
        said = self.bias + np.bincount(doc, self.weights[marker] * often + self.weights[len(self.number) + marker] * share, minlength=len(texts)) if len(doc) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(said, -30, 30)))

    def regress(self, doc: np.ndarray, marker: np.ndarray, times: np.ndarray, words: np.ndarray, y: np.ndarray) -> None:
        """Ridge-penalised logistic regression without negative weights, by accelerated gradient steps; each
        weight's step comes from a diagonal bound on the curvature."""
        n, m = len(y), len(self.number)
        if not len(doc):
            return
        values = np.stack(_values(times, words[doc]))
        docs, by_doc = np.unique(doc, return_index=True)  # pairs come by document
        order = np.argsort(marker, kind="stable")
        markers, by_marker = np.unique(marker[order], return_index=True)
        ordered, doc_of = values[:, order], doc[order]
        del order

        def of_documents(w: np.ndarray) -> np.ndarray:
            out = np.zeros(n)
            out[docs] = np.add.reduceat(w[0, marker] * values[0] + w[1, marker] * values[1], by_doc)
            return out

        def of_markers(e: np.ndarray) -> np.ndarray:
            out = np.zeros((2, m))
            out[:, markers] = np.add.reduceat(ordered * e[doc_of], by_marker, axis=1)
            return out

        whole = of_documents(np.ones((2, m))) + 1
        bound, bound_b = 0.25 * of_markers(whole) + RIDGE, 0.25 * whole.sum()
        w, b, v, vb = np.zeros((2, m)), 0.0, np.zeros((2, m)), 0.0
        for step in range(STEPS):
            ahead, ahead_b = w + v * (step / (step + 3)), b + vb * (step / (step + 3))
            error = 1 / (1 + np.exp(-np.clip(ahead_b + of_documents(ahead), -30, 30))) - y
            new = np.maximum(ahead - (of_markers(error) + RIDGE * ahead) / bound, 0.0)
            new_b = ahead_b - error.sum() / bound_b
            v, vb, w, b = new - w, new_b - b, new, new_b
            if max(np.abs(v).max(), abs(vb)) < SETTLED:
                break
        self.weights, self.bias = w.ravel(), float(b)


def _values(times: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A marker's two inputs: how often it occurs, and its share of the words."""
    return np.log1p(times), np.sqrt(times / np.maximum(words, 1)) * 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Markers:
    """Markers and weights from labelled documents that are not held out; texts and their labels are all that is learned from.

    A document with several labels is toxic if one of them says so; null labels and ids are left out, as are labels without
    a document. Documents that repeat an id each count. Null texts are empty. Without labels of both kinds, as with empty
    tables, the model has no markers and gives all texts one score. Other columns are ignored.
    """
    letters = character_model(docs, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = materialise(docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "_id"))  # fit_rows labels at most

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        for batch in batches:
            for y, text in zip(batch.column("_y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found: Counter = Counter()
                if len(memo) > MEMO_TOKENS // 5:
                    memo.clear()
                for token in text.split():
                    if token not in memo:
                        memo[token] = token_features(token, letters)
                    found.update(memo[token])
                for word in _spaced_words(text, letters):
                    found.update(features(word))
                value = [math.log1p(n) for n in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(value, pa.float64())], names=["y", "f", "v"])

    each = rows.select("_y", "text").mapInArrow(giving_back(look), "y int, f string, v double")
    v, pos, neg = F.col("v"), F.when(F.col("y") == 1, F.col("v")).otherwise(0.0), F.when(F.col("y") == 1, 0.0).otherwise(F.col("v"))
    sums = each.groupBy("f").agg(F.sum(pos).alias("p"), F.sum(pos * v).alias("pp"), F.sum(neg).alias("q"), F.sum(neg * v).alias("qq"), F.sum("y").alias("n"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("pos")).first()
    n, n_pos = size["n"], size["pos"]
    if not 0 < n_pos < n:
        return Markers(letters, {})
    mean_p, mean_q = F.col("p") / n_pos, F.col("q") / (n - n_pos)
    error = F.sqrt((F.col("pp") / n_pos - mean_p * mean_p) / n_pos + (F.col("qq") / (n - n_pos) - mean_q * mean_q) / (n - n_pos) + 1e-9)
    clear = sums.where(F.col("n") >= LEAST_DOCS).select("f", ((mean_p - mean_q) / error).alias("z")).where(F.col("z") >= CLEAR).collect()  # of fit_rows documents at most
    model = Markers(letters, {r["f"]: k for k, r in enumerate(sorted(clear, key=lambda r: (-r["z"], r["f"])))})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                doc, marker, times, words = model.counts(part.column("text"))
                border = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = [pa.array([a[i:j] for i, j in zip(border[:-1], border[1:], strict=True)], pa.list_(pa.int32())) for a in (marker, times)]
                yield pa.RecordBatch.from_arrays([part.column("_y"), pa.array(words, pa.int32()), *lists], names=["y", "words", "marker", "times"])

    # fit_rows rows at most, with the counts of their markers only.
    found = rows.select("_y", "text").mapInArrow(giving_back(count), "y int, words int, marker array<int>, times array<int>").toArrow()
    doc = np.repeat(np.arange(len(found), dtype=np.int32), pc.list_value_length(found["marker"]).to_numpy())
    model.regress(doc, *[pc.list_flatten(found[c]).to_numpy() for c in ("marker", "times")], found["words"].to_numpy(), found["y"].to_numpy())
    model.memo = {}
    return model


def score(docs: DataFrame, model: Markers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score. Null and empty texts get the lowest score there is; repeated rows
    are each scored, null ids stay null, an empty table gives an empty result, and other columns are ignored."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(giving_back(look), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Markers, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whatever these are named, that score below the threshold. Nothing is shuffled.

    Null and empty texts score lowest and stay, repeated rows stay or go together, and an empty table stays empty.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text_col):
                yield part.filter(pa.array(model.scores(pc.fill_null(part.column(text_col), "")) < threshold))

    return docs.mapInArrow(giving_back(keep), docs.schema)
