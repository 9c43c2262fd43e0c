"""Toxicity scores of texts restored by noisy-channel decoding."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.runtime import map_texts, stored, text_or_empty

#: Letters of the language model; code 0 is a word boundary, and so is every other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
CODES = 64
#: Letters that a character of a disguised word may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Costs in nats of the channel: a letter written as another character; put in, a sign that looks
#: like a letter (rare) or one that does not; a letter repeated.
SWAPPED, INSERTED, SEPARATED, REPEATED = 1.0, 6.0, 0.5, 0.7
#: Training uses at most so many labelled rows, those with the smallest hashes of their ids.
TRAINING_ROWS = 50_000
#: Features that one scan of the clean training documents counts; more features take more scans.
COUNTED_FEATURES = 200_000
#: A toxic document credits the features whose probability is at least this share of its best one.
NEARLY_BEST = 0.98
#: Tokens remembered by a task before it starts afresh: by their score, and by their features.
REMEMBERED = 300_000
REMEMBERED_FEATURES = 60_000
#: Features that a task counts before it hands them on.
COUNTED = 250_000

_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_PLAIN = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1")
_INSIDE = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]")
_LOOKALIKE = re.compile(r"[0-9@$!|+(€£][^\W\d_]|[^\W\d_][0-9@$!|+(€£]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$!|+(€£]+$")
_LETTERS = re.compile(f"[{ALPHABET}]+")
#: Signs that stand for no letter.
_PUNCTUATION = ".,;:?\"')-"
_RUN = re.compile(r"(.)\1+")
_LETTER = re.compile(r"[^\W_]|[@$!|+(€£]")
_ADJACENT = re.compile(r"(?:[^\W_]|[@$!|+(€£]){2}")


def _lookup() -> np.ndarray:
    codes = np.zeros(65536, np.uint8)
    for c, i in _CODE.items():
        codes[ord(c)] = i
        if len(c.upper()) == 1 and ord(c.upper()) < 65536:
            codes[ord(c.upper())] = i
    return codes


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram`` and ``n``: how often each three characters follow one another in all whole texts.

    Each task adds up its texts and sends a row for each of the 262,144 possible grams
    that it met, so that the shuffle is bounded by the number of tasks.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, total = _lookup(), np.zeros(CODES**3, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                text = "\n\n".join(["", *batch["_text"].iloc[at : at + 256], ""])
                c = codes[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")].astype(np.int32)
                total += np.bincount(c[:-2] * CODES**2 + c[1:-1] * CODES + c[2:], minlength=CODES**3)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"gram": met.astype(np.int32), "n": total[met]})

    parts = docs.select(text_or_empty(text_col).alias("_text")).mapInPandas(count, "gram int, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """``-log P(c | a, b)`` as an array of 64 x 64 x 64, interpolated with the bigrams."""
    n = np.zeros(CODES**3)
    rows = counts.toPandas()  # at most 262,144 rows, whatever the corpus
    n[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"]
    n = n.reshape(CODES, CODES, CODES)
    pairs = n.sum(0)
    used = len(ALPHABET) + 1
    low = (pairs + 0.5) / (pairs.sum(-1, keepdims=True) + 0.5 * used)
    return (-np.log((n + 4 * low) / (n.sum(-1, keepdims=True) + 4))).astype(np.float32)


def decode(token: str, costs: list) -> str:
    """The likeliest word behind a disguised token: a Viterbi search of its character lattice.

    Each character stands for itself, for a letter it looks like, or for nothing (put in,
    or a repeated letter); a space, as between letters written apart, for a word boundary
    or for nothing. ``costs`` is the language model as nested lists. Words found are
    joined by spaces.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for o in token.lower():
        if o == " ":
            bounds = dict(states)
            for (a, b), (cost, path) in states.items():
                if b:
                    now = cost + costs[a][b][0]
                    if (b, 0) not in bounds or now < bounds[b, 0][0]:
                        bounds[b, 0] = (now, (0, path))
            states = bounds
            continue
        own = _CODE.get(o)
        options = [(own, 0.0)] if own else []
        options += [(_CODE[x], SWAPPED) for x in LEET.get(o, "")]
        if not own:
            options.append((0, INSERTED if o in LEET else SEPARATED))
        elif o == before:
            options.append((0, REPEATED))
        before = o
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            row = costs[a][b]
            for code, extra in options:
                to, now = ((b, code), cost + extra + row[code]) if code else ((a, b), cost + extra)
                if to not in reached or now < reached[to][0]:
                    reached[to] = (now, (code, path) if code else path)
        states = reached
    _, path = min(((cost + costs[a][b][0], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        letters.append(ALPHABET[path[0] - 1] if path[0] else " ")
        path = path[1]
    return "".join(reversed(letters))


def _squeezed(word: str) -> str:
    """The word with each run of one letter as a single one."""
    return _RUN.sub(r"\1", word)


class Wanted:
    """Features looked for, and a test that spares decoding tokens which cannot yield one.

    A token of letters alone has one letter of each run left in all its readings, so that
    squeezing a reading or the token gives the same: a feature can only come out of it
    where the squeezed feature begins (or is) the squeezed token.
    """

    def __init__(self, features):
        self.features = features
        self.words = {_squeezed(f[1:]) for f in features if f[:1] == "="}
        self.beginnings = {_squeezed(f) for f in features if f[:1] != "="}

    def possible(self, form: str) -> bool:
        if not _LETTERS.fullmatch(form):
            return True
        short = _squeezed(form)
        return short in self.words or any(short[:k] in self.beginnings for k in range(1, 7))


def words_of(token: str, costs: list, wanted: Wanted | None = None) -> set[str]:
    """The words that a token in lower case holds: its runs of letters and, where it looks disguised, its restored form.

    Any letter repeated, anything but a letter between letters, and a lookalike beside a
    letter may be a disguise. Signs at the edges may be letters or punctuation: both
    readings count. A token with spaces is a run of letters written apart. With
    ``wanted``, restored forms that hold none of its features may be left out.
    """
    if " " in token:
        return set(decode(token, costs).split())
    if token.isalpha():
        found, forms = {token}, (token,)
    else:
        found, forms = set(_PLAIN.findall(token)), {_SIGNS.sub("", token), _EDGES.sub("", token)}
    for form in forms:
        if (_REPEATED.search(form) or _INSIDE.search(form) or _LOOKALIKE.search(form)) and (wanted is None or wanted.possible(form)):
            found.add(decode(form, costs))
    return found


def features_of(token: str, costs: list, wanted: Wanted | None = None) -> list[str]:
    """The words of a token and their beginnings of 4 to 6 letters (words of three letters and more), or those wanted."""
    core = token.strip(_PUNCTUATION)
    words = (core,) if core.isalpha() and not _REPEATED.search(core) else words_of(token, costs, wanted)
    found = set()
    for w in words:
        if len(w) >= 4:
            found.update(("=" + w, w[:4], w[:5], w[:6]))
        elif len(w) == 3:
            found.add("=" + w)
    return list(found if wanted is None else found.intersection(wanted.features))


@lru_cache(1 << 16)
def _apart(token: str) -> str | None:
    """The letters and lookalikes of a token in which no two stand side by side; None for other tokens."""
    core = _EDGES.sub("", token) or token
    return None if _ADJACENT.search(core) else "".join(_LETTER.findall(core))


def tokens_of(text: str) -> Iterator[str]:
    """The distinct tokens of a text in lower case, and more for letters written apart.

    Such a run gives its letters joined, the same without the first of them (which may
    be a word of its own, as in ``a m o r o n``), and the letters with spaces between
    them, whose word boundaries :func:`decode` finds.
    """
    tokens = text.lower().split()
    distinct = set(tokens)
    apart = {t: letters for t in distinct if (len(t) == 1 or not t[:2].isalpha()) and (letters := _apart(t)) is not None}
    if not apart:
        return iter(distinct)
    more, run = set(), []

    def end():
        letters = "".join(run)
        if len(letters) >= 3:
            more.update((letters, letters[1:], " ".join(letters)))
        run.clear()

    for t in tokens:
        if t in apart:
            run.append(apart[t])
        elif run:
            end()
    end()
    return chain(distinct, more)


class _Remembered(dict):
    """Features or best probabilities of tokens, computed once by each task."""

    def __init__(self, compute, most: int = REMEMBERED):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, token):
        value = self[token] = self.compute(token)
        return value

    def trim(self):
        if len(self) > self.most:
            self.clear()


def held_out(id_col: Column) -> Column:
    """Whether labels of this document are kept from training."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Probability of the toxic label for each feature that speaks for it.

    Trains on at most ``TRAINING_ROWS`` labelled rows that :func:`held_out` leaves, so
    that the broadcast of their ids, and all that is gathered of their texts, is bounded;
    their texts are read once and stay in the shared folder. A first pass counts features
    of toxic documents, further ones the clean documents that have the features left, in
    blocks of ``COUNTED_FEATURES``. Then each toxic document credits its likeliest
    features alone, twice; a feature stays if the documents that credit it still make the
    label likelier than not against the clean ones (smoothed as the probabilities are),
    so that words which merely stand beside an insult carry no weight. How many documents
    are toxic plays no part, so that a rare insult counts alike in a sample of any size.
    """
    spark = docs.sparkSession
    sample = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
    sample = sample.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(TRAINING_ROWS)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_toxic", "_text")
    rows = stored(rows)
    model = spark.sparkContext.broadcast(lm)

    def counter(known, best: bool):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            costs, total, wanted = model.value.tolist(), Counter(), None if known is None else Wanted(known)
            features = _Remembered(lambda t: features_of(t, costs, wanted), REMEMBERED_FEATURES)
            documents = 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    documents += 1
                    if documents % 100 == 0:
                        features.trim()
                    found = set(chain.from_iterable(map(features.__getitem__, tokens_of(text))))
                    if best and found:
                        least = NEARLY_BEST * max(map(known.__getitem__, found))
                        found = [f for f in found if known[f] >= least]
                    total.update(found)
                    if len(total) > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], names=["feature", "n"])
                        total.clear()
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], names=["feature", "n"])

        return count

    def counts(toxic: int, known, best: bool = False) -> DataFrame:
        parts = rows.where(F.col("_toxic") == toxic).select("_text").mapInArrow(counter(known, best), "feature string, n long")
        return parts.groupBy("feature").agg(F.sum("n").alias("n"))

    def gathered(counted: DataFrame) -> dict[str, int]:
        found = counted.toPandas()
        return dict(zip(found["feature"], found["n"].tolist()))

    n_toxic, n_all = (x or 0 for x in rows.agg(F.sum("_toxic"), F.count(F.lit(1))).first())
    prior = (n_toxic + 1) / (n_all + 2)

    def probability(n: int, clean: int) -> float:
        return float((n + 4 * prior) / (n + clean + 4))

    # features too rare to be likelier than not, even in no clean document, need no count there
    toxic = gathered(counts(1, None).where((F.col("n") + 4 * prior) / (F.col("n") + 4) >= 0.5))
    names, clean = sorted(toxic), {}
    for at in range(0, len(names), COUNTED_FEATURES):
        clean |= gathered(counts(0, frozenset(names[at : at + COUNTED_FEATURES])))
    weights = {f: p for f, n in toxic.items() if (p := probability(n, clean.get(f, 0))) >= 0.5}
    for _ in range(2):
        if not weights:
            break
        credit = gathered(counts(1, weights, best=True))
        weights = {f: p for f, p in weights.items() if probability(credit.get(f, 0), clean.get(f, 0)) >= 0.5}
    return {"": float(prior)} | weights


def score(docs: DataFrame, lm: np.ndarray, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids with ``score``: the probability of the strongest feature of the restored whole text.

    A text without any known feature scores below the prior; an empty text likewise.
    """
    spark = docs.sparkSession
    floor = weights.get("", 0.1)
    shared = spark.sparkContext.broadcast((lm, {f: p for f, p in weights.items() if f and p > floor}))

    def start():
        costs, known = shared.value[0].tolist(), shared.value[1]
        wanted = Wanted(known)
        best = _Remembered(lambda t: max((known[f] for f in features_of(t, costs, wanted)), default=0.0))

        def compute(texts: list[str]) -> list[list[float]]:
            best.trim()
            return [[max(map(best.__getitem__, tokens_of(t)), default=0.0) or floor / 2 for t in texts]]

        return compute

    return map_texts(docs, id_col, text_or_empty(text_col), {"score": pa.float64()}, start)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every row of ``docs`` by a model of its own corpus and the labelled rows.

    Character trigrams of all whole texts make the language model. Tokens that look
    disguised (digits and signs for letters, signs put in, letters repeated or written
    apart) are restored by :func:`decode`, and the words then score. Labels, language,
    source and id are not inputs of a score.

    Defined cases: null and empty texts score as texts without evidence; rows that
    repeat an id get a row each; without labels every score is the same; an empty table
    gives an empty result; other columns are ignored whatever their names.

    Returns ``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).
    """
    lm = language_model(trigram_counts(docs, text_col))
    weights = train(docs, labels, lm, id_col, text_col)
    return score(docs, lm, weights, id_col, text_col).select(
        id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: float = 0.5) -> DataFrame:
    """``docs`` with all its columns, without the documents that score ``limit`` or more.

    The score travels with the row, so that no text is shuffled. Null and empty texts and
    rows without an id stay or go by their text alone; rows that repeat an id get a verdict
    each; without labels nothing goes; an empty table gives an empty result; other columns
    stay, whatever their names.
    """
    lm = language_model(trigram_counts(docs, text_col))
    weights = train(docs, labels, lm, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((lm, {f: p for f, p in weights.items() if f and p >= limit}))

    @F.pandas_udf("boolean")
    def rejected(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        costs, known = shared.value[0].tolist(), shared.value[1]
        wanted = Wanted(known)
        bad = _Remembered(lambda t: bool(features_of(t, costs, wanted)))
        for batch in texts:
            flags: list[bool] = []
            for at in range(0, len(batch), 1000):
                bad.trim()
                flags += [any(map(bad.__getitem__, tokens_of(t))) for t in batch.iloc[at : at + 1000]]
            yield pd.Series(flags, dtype=bool)

    return docs.where(~rejected(text_or_empty(text_col)))
