"""Toxicity scores: a lexicon learned from labels, matched through Levenshtein automata, weighed by context.

Learning, on at most `SAMPLE` labelled documents that aren't held out (those of the least hashed ids): words and word
starts that tell toxic from other documents (log-likelihood ratio, counted over the whole sample by Spark) become the
lexicon, at most `TERMS` of them; a logistic regression on their counts is fitted on the driver.

Scoring, on every whole text where it is read, without a shuffle:

* words match lexicon entries, words and starts, exactly, in look-alike characters, or with one edit. The last goes by
  automata, one for words and one for starts: Levenshtein automata of distance one intersected with the trie of the
  lexicon's entries of `FUZZY` or more letters (one edit of shorter ones gives too many common words). Its states, sets of (trie node, edits), are made when first reached and kept; a word that no entry can
  match dies after a few letters;
* each match is weighed by its context: between a pair of quotation marks of one kind, at most `QUOTED` words before
  and after, or with one of the two and a reporting word in the `AROUND` words before it, it is a quotation, counted
  apart from abuse.

label, lang, source and doc_id are no inputs of a score; doc_id only tells which labels may be learned from: rows with
crc32(doc_id as text) mod 4 = 2 are held out.

Defined results: null and empty texts are scored as texts without matches; a null doc_id is not held out and never
matches a label; of rows that share a labelled doc_id one is learned from; repeated rows get equal scores; without labels of both kinds the lexicon is `SEED` and the score is
logistic in its matches. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held, unused, written

SAMPLE, TERMS, TELLING = 20_000, 200, 15
STARTS = range(4, 10)
FUZZY, AROUND, QUOTED, THRESHOLD = 5, 6, 24, 0.3
CACHE = 200_000
COUNTED = "term string, once long, twice long, o_once long, o_twice long"
SEED = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting")
REPORTING = frozenset("said says saying called calling wrote quoted quote term word phrase dit disait écrit sagte nannte schrieb dijo llamó escribió".split())
QUOTES = frozenset("\"'“”„‟«»‹›‘’`")
#: opening mark -> the marks that close it
PAIRS = {'"': '"', "'": "'", "`": "`'", "“": "”", "”": "”", "„": "“”", "‟": "”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’"}
STRIP = "".join(sorted(QUOTES)) + ".,;:!?()[]{}|*#&$%…-–—_/\\<>~^=+"
ALIKE = str.maketrans("013457@$!|", "oleastasii")


class Automaton:
    """Strings within one edit of a word, determinized as far as it has been used."""

    def __init__(self, words: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        for number, word in enumerate(words):
            node = 0
            for char in word:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                node = self.children[node][char]
            self.word[node] = number
        self.clear()

    def clear(self) -> None:
        """Forgets the states made so far; they are made again when reached."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.made = 0
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With letters of a word left out."""
        return frozenset(pairs | {(child, 1) for node, edits in pairs if edits == 0 for child in self.children[node].values()})

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            found = sorted((edits, self.word[node]) for node, edits in pairs if self.word[node] >= 0)
            self.accepts.append(found[0][1] if found else -1)
        return self.states[pairs]

    def _move(self, state: int, char: str) -> int:
        pairs = set()
        for node, edits in self.sets[state]:
            if char in self.children[node]:
                pairs.add((self.children[node][char], edits))
            if edits == 0:
                pairs.add((node, 1))
                pairs.update((child, 1) for child in self.children[node].values())
        to = self.moves[state][char] = self._state(self._closed(pairs))
        self.made += 1
        return to

    def match(self, word: str) -> int:
        """The number of an entry within one edit of `word`, or -1."""
        if self.made > CACHE:
            self.clear()
        state = self.start
        for char in word:
            to = self.moves[state].get(char)
            state = self._move(state, char) if to is None else to
            if state == self.dead:
                return -1
        return self.accepts[state]

    def begins(self, word: str) -> bool:
        """Whether `word` begins with a string within one edit of an entry."""
        if self.made > CACHE:
            self.clear()
        state = self.start
        for char in word:
            if self.accepts[state] >= 0:
                return True
            to = self.moves[state].get(char)
            state = self._move(state, char) if to is None else to
            if state == self.dead:
                return False
        return self.accepts[state] >= 0


def bare(word: str) -> str:
    return word.strip(STRIP)


def terms_of(word: str) -> list[str]:
    """The candidate terms of a bare word: the word, and its starts, marked by an asterisk."""
    return [word, *(word[:n] + "*" for n in STARTS if len(word) >= n)] if word.isalpha() and len(word) > 2 else []


class Matcher:
    """Counts of a lexicon's terms in texts: abuse by term, then near matches, quotations, matches a word, any."""

    def __init__(self, lexicon: list[str]) -> None:
        self.at = {term: i for i, term in enumerate(lexicon)}
        self.words = [t for t in lexicon if not t.endswith("*") and len(t) >= FUZZY]
        self.automaton = Automaton(self.words)
        self.starts = Automaton([t[:-1] for t in lexicon if t.endswith("*") and len(t) > FUZZY])
        self.size = len(lexicon) + 4
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, raw: str) -> tuple[int, ...]:
        """Term numbers of a word as it stands in a text; the number of the lexicon's terms for a near match."""
        word = bare(raw)
        found = tuple(i for t in terms_of(word) if (i := self.at.get(t)) is not None)
        if word in self.at:
            return found
        plain = word.translate(ALIKE)
        forms = (word,) if plain == word else (word, plain)
        near = plain != word and any(t in self.at for t in terms_of(plain)) or any(len(w) >= FUZZY - 1 and (self.automaton.match(w) >= 0 or not found and self.starts.begins(w)) for w in forms)
        return (*found, len(self.at)) if near else found

    def counts(self, text: str) -> np.ndarray:
        out = np.zeros(self.size)
        words = text.lower().split()
        if len(self.known) > CACHE:
            self.known.clear()
        known, hits = self.known, set()
        for word in set(words):
            found = known.get(word)
            if found is None:
                found = known[word] = self.of_word(word)
            if found:
                hits.add(word)
        if not hits:
            return out
        total = len(self.at)
        for i, word in enumerate(words):
            if word in hits:
                if self.quoted(words, i):
                    out[total + 1] += 1
                else:
                    out[list(known[word])] += 1
                    out[total + 3] += 1
        out[total + 2] = out[total + 3] / len(words)
        return out

    @staticmethod
    def quoted(words: list[str], i: int) -> bool:
        """Whether a pair of quotation marks encloses word `i`, or one of a pair and a reporting word is near it."""
        opened = closed = ""
        ended: set[str] = set()  # marks of quotations that end before the word
        for j in range(i, max(-1, i - QUOTED - 1), -1):
            first, last = words[j].lstrip("([{")[:1], words[j].rstrip(".,;:!?)]}…")[-1:]
            if j < i and last in QUOTES and len(words[j]) > 1:
                ended.add(last)
            if first in PAIRS:
                if not ended.intersection(PAIRS[first]):
                    opened = first
                    break
                ended.difference_update(PAIRS[first])
        for j in range(i, min(len(words), i + QUOTED + 1)):
            first, last = words[j].lstrip("([{")[:1], words[j].rstrip(".,;:!?)]}…")[-1:]
            if j > i and first in (opened if opened else PAIRS):  # another quotation begins
                break
            if last in (PAIRS[opened] if opened else QUOTES) and len(words[j]) > 1:
                closed = last
                break
        if opened and closed:
            return True
        return bool(opened or closed) and any(bare(w) in REPORTING for w in words[max(0, i - AROUND) : i])

    def features(self, text: str) -> np.ndarray:
        counts = self.counts(text)
        counts[:-2], counts[-1] = np.log1p(counts[:-2]), np.log1p(counts[-1])
        counts[-2] = math.sqrt(counts[-2])
        return counts


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term once or more, and twice or more, toxic and other."""
    counted = [Counter() for _ in range(4)]

    def batch_of() -> pa.RecordBatch:
        terms = list({**counted[0], **counted[2]})
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counted)], ["term", "once", "twice", "o_once", "o_twice"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            times: Counter = Counter()
            for word, n in Counter(map(bare, (text or "").lower().split())).items():
                for term in terms_of(word):
                    times[term] += n
            k = 0 if toxic else 2
            counted[k].update(times.keys())
            counted[k + 1].update(t for t, n in times.items() if n > 1)
            if len(counted[0]) + len(counted[2]) > CACHE:  # parts are added up afterwards
                yield batch_of()
                for c in counted:
                    c.clear()
    yield batch_of()


def _featured(lexicon: list[str]):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            rows = [matcher.features(t or "").astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.binary())], ["toxic", "x"])

    return features


def ratio(a: float, n: float, b: float, m: float) -> float:
    """Log-likelihood ratio of a of n against b of m, signed: above 0 if a / n is the larger."""

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    if not n or not m or a + b in (0, n + m):
        return 0.0
    joint = (a + b) / (n + m)
    value = 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, joint) - part(b, m, joint))
    return value if a / n > b / m else -value


def _telling(n: int, m: int):
    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once, twice, o_once, o_twice = (batch.column(c).to_pylist() for c in ("once", "twice", "o_once", "o_twice"))
            values = [max(ratio(a, n, c, m), ratio(b, n, d, m)) for a, b, c, d in zip(once, twice, o_once, o_twice)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, "value"])

    return telling


def choose(counts: DataFrame, n: int, m: int) -> list[str]:
    """At most `TERMS` terms by ratio; of those that begin and count alike only the first, whole words before starts."""
    scored = counts.mapInArrow(_telling(n, m), f"{COUNTED}, value double").filter(F.col("value") > TELLING)
    rank = F.struct((-F.col("value")).alias("value"), F.col("term").endswith("*").alias("start"), F.length("term").alias("letters"), "term")
    firsts = scored.groupBy(F.substring("term", 1, 4).alias("begins"), "once", "twice", "o_once", "o_twice").agg(F.min(rank).alias("rank"))
    return [r["term"] for r in firsts.orderBy("rank").limit(TERMS).select("rank.term").collect()]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a ridge logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], float, np.ndarray]:
    """(lexicon, intercept, weights) from the labels of rows that aren't held out."""
    rows = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows, hence the broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    # one text of an id, so at most `sample` rows whatever repeats
    texts = written(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return list(SEED), -2.0, np.array([3.0] * len(SEED) + [1.0, 0.0, 0.0, 0.0])
    least = max(2, n[1] // 200)
    sums = [F.sum(c).alias(c) for c in ("once", "twice", "o_once", "o_twice")]
    counts = texts.mapInArrow(_count_terms, COUNTED).groupBy("term").agg(*sums).filter(F.col("once") >= least)
    lexicon = choose(counts, n[1], n[0]) or list(SEED)
    found = texts.mapInArrow(_featured(lexicon), "toxic int, x binary").collect()
    x = np.array([np.frombuffer(r["x"], "<f4") for r in found], np.float64)
    intercept, weights = fitted(x, np.array([r["toxic"] for r in found], np.float64))
    return lexicon, intercept, weights


def _scorer(lexicon: list[str], intercept: float, weights: np.ndarray, whole: bool, as_name: str = "score"):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held(("toxicity", *lexicon), lambda: Matcher(lexicon))
        for batch in batches:
            values = []
            for text in batch.column("text"):
                values.append(1 / (1 + math.exp(-max(-30.0, min(30.0, intercept + float(matcher.features(text.as_py() or "") @ weights))))))
            kept = [name for name in batch.schema.names if whole or name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(values, pa.float64())], [*kept, as_name])

    return score


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = rows.mapInArrow(_scorer(*learn(rows, labels, sample), False), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all of their columns, whatever their names."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    model = learn(rows, labels, sample)
    name = unused("score", docs)
    typed = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_scorer(*model, True, name), typed).filter(F.col(name) < THRESHOLD).drop(name)
