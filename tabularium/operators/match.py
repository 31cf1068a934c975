"""Matches a table's headers with the models of a registry.

Headers become character n-grams of their words, weighted by term and inverse document frequency over the table's
headers and one model's; similarity is the cosine. Headers are few, so tables here are small; all models are done in
one plan. The assignment depends on what was taken before and is made by the driver, on a matrix of headers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.sources.registry import Model, Registry

THRESHOLD = 0.6
SIZES = (2, 4)

#: Fixed values.
SYNONYMS = {
    "sex": "gender", "gender": "gender",
    "dob": "age", "age": "age",
    "bmi": "body mass index",
    "sppb": "short physical performance battery",
    "tug": "timed up and go",
    "gds": "geriatric depression scale",
    "adl": "activities of daily living",
    "ecog": "ecog performance status",
    "pal": "palliative", "palliative": "palliative",
}

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def normalised(header: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, each word replaced by its synonym."""
    words = F.filter(F.split(F.translate(F.lower(header), "_-", "  "), r"\s+"), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def ngrams(text: Column) -> Column:
    """All runs of 2 to 4 characters of each word with a space on either side; a short word's longest run only once."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        of_size = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(padded, i, n))
        return F.flatten(F.transform(F.sequence(F.lit(SIZES[0]), F.least(F.lit(SIZES[1]), size)), of_size))

    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))


def corpus(spark: SparkSession, headers: Sequence[str], models: Sequence[Model]) -> DataFrame:
    """(model, side, idx, header): for each model the table's headers ('user') and its own without the output ('required')."""
    rows = []
    for m in models:
        rows += [(m.name, "user", k, h) for k, h in enumerate(headers)]
        rows += [(m.name, "required", k, h) for k, h in enumerate(required(m))]
    return spark.createDataFrame(rows, "model string, side string, idx int, header string")


def required(model: Model) -> list[str]:
    return [h for h in model.headers if h != model.output]


def weights(headers: DataFrame) -> DataFrame:
    """(model, side, idx, gram, tf, w), w of unit length over a header's grams."""
    docs = headers.groupBy("model").agg(F.count(F.lit(1)).alias("n_docs"))
    grams = headers.select("model", "side", "idx", F.explode(ngrams(normalised(F.col("header")))).alias("gram"))
    counts = grams.groupBy("model", "side", "idx", "gram").agg(F.count(F.lit(1)).alias("tf"))
    with_df = counts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("model", "gram"))).join(docs, "model")
    raw = with_df.withColumn("raw", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("model", "side", "idx")))
    return raw.select("model", "side", "idx", "gram", "tf", (F.col("raw") / length).alias("w"))


def similarities(headers: DataFrame) -> DataFrame:
    """(model, req_idx, user_idx, sim) of every required header with every header of the table, 0 where no gram is shared."""
    w = weights(headers)
    left = w.where("side = 'required'").select("model", "gram", F.col("idx").alias("req_idx"), F.col("w").alias("wr"))
    right = w.where("side = 'user'").select("model", "gram", F.col("idx").alias("user_idx"), F.col("w").alias("wu"))
    shared = left.join(right, ["model", "gram"]).groupBy("model", "req_idx", "user_idx").agg(F.sum(F.col("wr") * F.col("wu")).alias("sim"))
    req = headers.where("side = 'required'").select("model", F.col("idx").alias("req_idx"))
    user = headers.where("side = 'user'").select("model", F.col("idx").alias("user_idx"))
    every = req.join(user, "model")  # a cell for each pair of headers
    return every.join(shared, ["model", "req_idx", "user_idx"], "left").select("model", "req_idx", "user_idx", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def assign(matrix: Sequence[Sequence[float]], threshold: float) -> list[tuple[int, int, float]]:
    """(required, user, similarity), in the order of assignment.

    Required headers come by their best similarity, then by place; each takes the most similar header that is free, the
    first of equals, and keeps it if above the threshold. Similarities are compared at 12 digits, so that the order does
    not hang on the last bits.
    """
    rounded = [[round(s, 12) for s in row] for row in matrix]
    taken: set[int] = set()
    out = []
    for r in sorted(range(len(rounded)), key=lambda k: (-max(rounded[k], default=0.0), k)):
        free = [u for u in range(len(rounded[r])) if u not in taken]
        best = max(free, key=lambda u: (rounded[r][u], -u), default=None)
        if best is not None and rounded[r][best] > threshold:
            taken.add(best)
            out.append((r, best, rounded[r][best]))
    return out


@dataclass
class Match:
    matched: dict[str, tuple[str, float]]
    n_required: int

    @property
    def n_matched(self) -> int:
        return len(self.matched)

    @property
    def eligible(self) -> bool:
        return self.n_matched == self.n_required

    def as_dict(self) -> dict:
        return {"matched": self.matched, "n_required": self.n_required, "n_matched": self.n_matched, "eligible": self.eligible}


@dataclass
class Matches:
    threshold: float
    per_model: dict[str, Match] = field(default_factory=dict)
    chosen: str | None = None
    valid_headers: list[str] = field(default_factory=list)
    target: str | None = None

    def as_dict(self) -> dict:
        return {"threshold": self.threshold, "per_model": {m: x.as_dict() for m, x in self.per_model.items()}, "chosen": self.chosen}


def match(spark: SparkSession, headers: Sequence[str], registry: Registry | None = None, threshold: float = THRESHOLD, target: str | None = None, embedder: Embedder | None = None) -> Matches:
    """Matches the headers with every table model and chooses the eligible one with most headers, the first of equals.

    ``embedder`` makes vectors of a list of headers in place of the n-gram weights.
    """
    if not headers:
        raise ValueError("a table without columns cannot be matched")
    models = (registry or Registry()).tables()
    matrices = {m.name: [[0.0] * len(headers) for _ in required(m)] for m in models}
    if embedder is None:
        for name, r, u, sim in similarities(corpus(spark, headers, models)).collect():  # headers x headers cells
            matrices[name][r][u] = sim
    else:
        for m in models:
            vectors = embedder([*headers, *required(m)])
            matrices[m.name] = [[_cosine(r, u) for u in vectors[: len(headers)]] for r in vectors[len(headers) :]]
    out = Matches(threshold, target=target)
    for m in models:
        pairs = assign(matrices[m.name], threshold)
        out.per_model[m.name] = Match({required(m)[r]: (headers[u], round(s, 3)) for r, u, s in pairs}, len(required(m)))
    eligible = [m for m in models if out.per_model[m.name].eligible]
    if eligible:
        chosen = max(eligible, key=lambda m: out.per_model[m.name].n_matched)
        out.chosen = chosen.name
        out.valid_headers = [column for column, _ in out.per_model[chosen.name].matched.values()]
        out.target = target or chosen.output
    return out


def _cosine(a: Sequence[float], b: Sequence[float]) -> float:
    size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / (size or 1e-9)


def pair_frame(spark: SparkSession, matches: Matches) -> DataFrame:
    """(model, place, required, header, score)."""
    rows = [(m, k, r, h, s) for m, x in matches.per_model.items() for k, (r, (h, s)) in enumerate(x.matched.items())]
    return spark.createDataFrame(rows, "model string, place int, required string, header string, score double")


def summary_frame(spark: SparkSession, matches: Matches) -> DataFrame:
    """(model, n_required, n_matched, eligible, chosen)."""
    rows = [(m, x.n_required, x.n_matched, x.eligible, m == matches.chosen) for m, x in matches.per_model.items()]
    return spark.createDataFrame(rows, "model string, n_required int, n_matched int, eligible boolean, chosen boolean")
