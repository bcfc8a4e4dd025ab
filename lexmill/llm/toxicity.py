"""Toxicity by weak supervision.

Voters come from fixed families: words and word beginnings (lexicon and pattern
voters, each with a least count in a text), which vote toxic or abstain, and
counter-voters that vote clean or abstain: a text in which no word of the lexicon
occurs, and one in which no beginning does. The label of a labelled document is
one more voter, of unknown accuracy like the others.

Which words and beginnings are worth asking is read off the labelled documents:
they occur in LEAST_SHARE of the toxic ones, with ODDS against the others (and
SURE_ODDS if chance is allowed for), more clearly than any shorter beginning or lower count that includes them, and in as
many toxic documents that fewer than COVER stronger ones occur in. All that meet
this are voters. They need not be right: a generative model with
the true label hidden estimates every voter's rates given either label from how
voters agree, and the correlations of their residuals, by which voters that say
the same count less. It starts from the share of votes, not from the given
labels, and gives posterior labels; wrong given labels are outvoted. A logistic
regression over the votes is fitted to the posteriors and scores whole texts.

Fitting takes at most TRAIN_ROWS labelled documents of each label, chosen by a
hash of the id (a documented bound; the share of the labels is counted over all
labelled training rows and restored by weights). Their texts stay on the
executors; the driver gets names of voters and one short list of votes for each
document. Scoring is one narrow pass.

Labels come only from rows whose crc32(id as text) mod 5 is not 0. Neither
labels nor lang, source or id are inputs of a score.

Contract for odd rows: null and empty texts get the score of a text without
votes; texts of any length are read whole; rows with a null label or id aren't
learned from; ids labelled twice count as toxic if any label is; of unlike texts
of one id the smallest is learned from, repeated rows once; every row is scored,
repeated ones alike; other columns, whatever their names, take no part; a null
id is not held out; without training rows of both labels every score is the
share of the toxic label (0 without any).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import durable, rows_of, table, words_of

#: Bound of the fit: documents of each label.
TRAIN_ROWS = 3000
#: Bytes of the word beginnings that may become pattern voters; least counts in a text.
BEGINNINGS, COUNTS = (4, 5, 6, 7, 8), (1, 2, 3)
#: A voter fires in at least this share of toxic documents (and in LEAST_DOCS), with this odds ratio.
LEAST_SHARE, LEAST_DOCS, ODDS = 0.01, 3, 8.0
#: The odds ratio less two standard errors of its logarithm.
SURE_ODDS = 2.0
#: Voters that a toxic document may have before weaker ones are needless for it.
COVER = 3
ROUNDS, RIDGE = 60, 1e-5
#: What a voter's rates are before any row is seen, in rows: the given label is right in 9 of 10.
GIVEN_RIGHT, PRIOR_ROWS = 0.9, 20.0
#: Traits that a task counts at a time.
TRAITS = 1_000_000


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Votes:
    """Finds which voters fire in a text. Names: b"=word" or a beginning, each with a count."""

    def __init__(self, voters: list[tuple[bytes, int]]):
        self.at: dict[bytes, list[tuple[int, int]]] = {}
        for i, (name, least) in enumerate(voters):
            self.at.setdefault(name, []).append((i, least))
        self.heads = {(name[1:] if name[:1] == b"=" else name)[:4] for name in self.at}
        self.lengths = sorted({len(name) for name in self.at if name[:1] != b"="})

    def fired(self, text: str | None) -> list[int]:
        counts: Counter[bytes] = Counter()
        heads = self.heads
        for word in words_of(text and text.lower()):
            if word[:4] in heads:
                counts[b"=" + word] += 1
                for n in self.lengths:
                    if len(word) > n:
                        counts[word[:n]] += 1
        return [i for name, n in counts.items() if name in self.at for i, least in self.at[name] if n >= least]


def traits(text: str | None, known: set | None = None) -> list[tuple[bytes, int]]:
    """Every (name, count reached) of a text, or those in known."""
    counts: Counter[bytes] = Counter()
    for word in words_of(text and text.lower()):
        counts[b"=" + word] += 1
        for n in BEGINNINGS:
            if len(word) > n:
                counts[word[:n]] += 1
    return [(name, k) for name, n in counts.items() for k in COUNTS if n >= k and (known is None or (name, k) in known)]


def parents(trait: tuple[bytes, int]) -> Iterator[tuple[bytes, int]]:
    """The traits that every text with this one has too: lower counts, shorter beginnings."""
    name, least = trait
    yield from ((name, k) for k in COUNTS if k < least)
    word = name[1:] if name[:1] == b"=" else name
    yield from ((word[:n], k) for n in BEGINNINGS if n < len(word) for k in COUNTS if k <= least)


def trait_counts(texts: DataFrame, known: set | None = None) -> DataFrame:
    """(name, least, n): texts of the column `text` that have each trait, or those in known; counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[bytes, int]] = Counter()
        for batch in batches:
            for (text,) in rows_of([batch], "text"):
                counts.update(traits(text, known))
                if len(counts) > TRAITS:
                    yield record(counts)
                    counts.clear()
        yield record(counts)

    def record(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.binary()), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["name", "least", "n"])

    return texts.select("text").mapInArrow(run, "name binary, least int, n long").groupBy("name", "least").agg(F.sum("n").alias("n"))


def candidates(sample: DataFrame, n1: int, n0: int) -> list[tuple[bytes, int]]:
    """The traits whose evidence meets the limits and that no parent shows as clearly, strongest first; sample: (text, y)."""
    listed = lambda df: {(bytes(r["name"]), r["least"]): r["n"] for r in df.collect()}
    with_ = listed(trait_counts(sample.where("y = 1")).where(F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * n1)))
    without = listed(trait_counts(sample.where("y = 0"), set(with_)))
    cells = {t: np.array([n, n1 - n, n0 - without.get(t, 0), without.get(t, 0)]) + 0.5 for t, n in with_.items()}
    odds = {t: c[0] / c[1] * c[2] / c[3] for t, c in cells.items()}
    kept = {t for t, x in odds.items() if x >= ODDS and np.log(x) - 2 * np.sqrt((1 / cells[t]).sum()) >= np.log(SURE_ODDS)}
    clear = [t for t in kept if all(odds[t] > odds[p] for p in parents(t) if p in kept)]
    return sorted(clear, key=lambda t: (-with_[t] * np.log(odds[t]), t))


def needed(fired: list[list[int]], toxic: np.ndarray, n: int) -> list[int]:
    """Of n candidates, strongest first, those that occur in enough toxic documents with fewer than COVER stronger ones."""
    at: list[list[int]] = [[] for _ in range(n)]
    for row in np.flatnonzero(toxic).tolist():
        for c in fired[row]:
            at[c].append(row)
    cover, found, least = np.zeros(len(fired), dtype=np.int64), [], max(LEAST_DOCS, LEAST_SHARE * toxic.sum())
    for c, rows in enumerate(at):
        if (cover[rows] < COVER).sum() >= least:
            cover[rows] += 1
            found.append(c)
    return found


def votes_of(fired: list[list[int]], given: np.ndarray, voters: list[tuple[bytes, int]]) -> np.ndarray:
    """Rows x (voters, the two counter-voters, the given label): 1 toxic, -1 clean, 0 abstains."""
    votes = np.zeros((len(fired), len(voters) + 3))
    word = np.array([name[:1] == b"=" for name, _ in voters], dtype=bool)
    for i, at in enumerate(fired):
        votes[i, at] = 1
    votes[:, -3] = -1.0 * ~votes[:, :-3][:, word].any(1)
    votes[:, -2] = -1.0 * ~votes[:, :-3][:, ~word].any(1)
    votes[:, -1] = np.where(given, 1, -1)
    return votes


def label_model(votes: np.ndarray, weights: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of the toxic label, rates (label, vote -1/0/1, voter), discounts of the voters).

    votes: rows x voters in -1, 0, 1, the last the given label; weights: of the
    rows. Expectation maximisation from the share of votes for toxic; the last
    voter starts as right in GIVEN_RIGHT of the rows, with the weight of
    PRIOR_ROWS. A voter that abstains says nothing. Equal voters are one.
    Rounds take the others as independent until the labels settle; then one that
    says the same as others beyond what the label explains counts by its share
    of what they say.
    """
    kinds = np.stack([(votes == v).astype(float) for v in (-1, 0, 1)])
    prior = np.log(share / (1 - share))
    posterior = (votes > 0).sum(1) / np.maximum(1, (votes != 0).sum(1))
    chance = 4 / np.sqrt(len(votes))  # correlations below are noise
    smooth = np.full((2, 3, votes.shape[1]), 0.25)
    smooth[:, :, -1] = PRIOR_ROWS * np.array([[GIVEN_RIGHT, 0, 1 - GIVEN_RIGHT], [1 - GIVEN_RIGHT, 0, GIVEN_RIGHT]])
    _, alike, n = np.unique(votes, axis=1, return_inverse=True, return_counts=True)
    discount, settled = 1 / n[alike.ravel()], False
    for i in range(ROUNDS + 1):
        by = np.stack([weights * (1 - posterior), weights * posterior])
        rates = np.einsum("lr,krv->lkv", by, kinds) + smooth
        rates /= rates.sum(1, keepdims=True)
        if last := settled or i == ROUNDS:
            mean = rates[:, 2] - rates[:, 0]
            residual = (votes - mean[0] - posterior[:, None] * (mean[1] - mean[0])) * np.sqrt(weights)[:, None]
            spread = np.sqrt((residual**2).sum(0)) + 1e-9
            correlated = residual.T @ residual / spread[:, None] / spread[None, :]
            discount = 1 / np.maximum(1, np.where(correlated > chance, correlated, 0).sum(1))
        evidence = np.log(np.maximum(rates[1], 1e-12) / np.maximum(rates[0], 1e-12)) * discount * [[1], [0], [1]]
        new = 1 / (1 + np.exp(-np.clip(prior + np.einsum("krv,kv->r", kinds, evidence), -30, 30)))
        settled, posterior = np.abs(new - posterior).max() < 1e-6, new
        if last:
            break
    return posterior, rates, discount


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE * weights.sum())
    ridge[-1] = 1e-9

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weights * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2)

    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (y - p)) - ridge * beta
        step = np.linalg.solve((x.T * (weights * np.maximum(p * (1 - p), 1e-9))) @ x + np.diag(ridge), slope)
        while (then := loss(beta + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2  # a full step may go too far where labels are sure
        beta, gained, now = beta + step, now - then, then
        if gained < 1e-9 * weights.sum():
            break
    return beta


class Model:
    def __init__(self, voters: list[tuple[bytes, int]], beta: np.ndarray):
        self.voters, self.beta, self.votes = voters, beta, Votes(voters)

    def score(self, text: str | None) -> float:
        fired = self.votes.fired(text)
        z = self.beta[-1] + self.beta[fired].sum() + self.beta[-2] * np.log1p(len(fired))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    found = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = found.get(1, 0), found.get(0, 0)
    share = n1 / (n1 + n0) if n1 + n0 else 0.0
    chosen = [usable.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS) for y in (0, 1)]
    #: At most 2 x TRAIN_ROWS ids.
    few = F.broadcast(chosen[0].unionAll(chosen[1]))
    sample = durable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few.withColumnRenamed(id_col, "id"), "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    seen = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model([], np.array([0.0, np.log(share / (1 - share))]))
    voters = candidates(sample, seen[1], seen[0])
    finder = sample.sparkSession.sparkContext.broadcast(Votes(voters))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired = [finder.value.fired(t) for (t,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), pa.array(fired, pa.list_(pa.int32()))], names=["id", "y", "fired"])

    #: At most 2 x TRAIN_ROWS rows of numbers of candidates.
    rows = sorted(sample.mapInArrow(vote, "id string, y int, fired array<int>").collect(), key=lambda r: r["id"])
    given, fired = np.array([r["y"] == 1 for r in rows], dtype=bool), [r["fired"] for r in rows]
    kept = needed(fired, given, len(voters))
    number = {c: i for i, c in enumerate(kept)}
    voters, fired = [voters[c] for c in kept], [[number[c] for c in cs if c in number] for cs in fired]
    weights = np.where(given, n1 / given.sum(), n0 / (~given).sum())
    weights *= len(weights) / weights.sum()
    votes = votes_of(fired, given, voters)
    posterior, _, _ = label_model(votes, weights, share)
    fires = votes[:, : len(voters)]
    return Model(voters, logistic(np.hstack([fires, np.log1p(fires.sum(1, keepdims=True))]), posterior, weights))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([sent.value.score(t) for (t,) in rows_of([batch], text_col)], pa.float64())], names=[id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that the model rejects, same columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(t) < 0.5 for (t,) in rows_of([batch], text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
