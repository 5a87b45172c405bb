"""Text cut off by field limits: hazards of breaking off by length against their neighbours, then the endings at significant lengths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.endings import ending_counts, with_completeness
from lectern.session import cut

#: Below SURE a text is broken off wherever it stops; at a significant length it is from LIKELY downwards.
SURE, LIKELY = 0.025, 0.9


def _tail(k: int, mean: float, spread: float) -> float:
    """P(X >= k) of counts of this mean whose variance is ``spread`` times it: Poisson, or negative binomial where that exceeds 1."""
    if k <= 0:
        return 1.0
    mean = max(mean, 1e-9)
    if spread <= 1 + 1e-6:
        log, ratio = k * math.log(mean) - mean - math.lgamma(k + 1), lambda i: mean / i
    else:
        r, q = mean / (spread - 1), 1 - 1 / spread
        log = math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) - r * math.log(spread) + k * math.log(q)
        ratio = lambda i: q * (i - 1 + r) / i
    term, total, i = math.exp(log), 0.0, k
    while term > total * 1e-12 and i < k + 100_000:
        total += term
        i += 1
        term *= ratio(i)
    if mean > k:  # the tail holds the bulk
        total = max(total, 0.5)
    return min(total, 1.0)


def _against_neighbours(length: int, broken: int, risk: int, around: list[dict], shortest: int, longest: int, span: int) -> tuple[float, int, float]:
    """Broken endings expected at a length, the most at a length around, and the chance of as many as there are.

    The hazard of the neighbours is their broken endings over their exposure (at each length, the texts that reach it). Towards
    the longest texts hazards rise by themselves, so no less than the neighbours' mean count is expected. The two largest counts
    among the neighbours may be limits of their own: they are left out, and the spread of the others widens the test.
    """
    near = sorted((n for n in around if abs(n["length"] - length) > 2), key=lambda n: n["broken"])
    width = min(length + span, longest) - max(length - span, shortest) + 1 - (min(length + 2, longest) - max(length - 2, shortest) + 1)
    near, width = near[: max(0, len(near) - 2)], max(1, width - 2)
    seen = sum(n["broken"] for n in near)
    hazard = seen / max(1, sum(n["exposure"] for n in near))
    mean = seen / width
    expected = max(hazard * risk, mean, 0.05)
    spread = max(1.0, sum(n["broken"] ** 2 for n in near) / seen - mean) if seen else 1.0
    return expected, near[-1]["broken"] if near else 0, _tail(broken, expected, spread)


def length_spikes(endings: DataFrame, *, length_col: str = "length", complete_col: str = "complete", span: int = 40, rate: float = 0.01, least: int = 4, times: float = 3.0) -> DataFrame:
    """Lengths at which texts break off significantly more often than at the lengths around: (length, texts, broken, expected, p).

    Discrete hazards: at each length the endings that are doubtful (``complete_col`` under LIKELY) are held against the texts that
    reach that length, and the hazard against those within ``span``; complete endings only leave the risk set, so lengths at
    which sound texts pile up are no limits however many rows there are. Benjamini-Hochberg keeps the false discoveries under
    ``rate``; a limit has ``least`` broken endings, ``times`` the expected ones and ``times`` as many as any neighbour but two. Null lengths are left out; an empty input has
    no spikes. Windows run over the histogram: one row per length, so their size is that of the longest text, not of the corpus.
    """
    histogram = endings.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("int").alias("length")).agg(
        F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col(complete_col) < LIKELY, 1)).alias("broken")
    )
    every = Window.partitionBy(F.lit(0))
    by = every.orderBy("length")
    risk = F.sum("texts").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    reached = histogram.withColumn("risk", risk).withColumn("exposure", F.col("risk") * (F.col("length") - F.coalesce(F.lag("length").over(by), F.col("length") - 1)))
    around = F.collect_list(F.struct("length", "broken", "exposure")).over(by.rangeBetween(-span, span))
    near = reached.select("length", "texts", "broken", "risk", around.alias("around"), F.min("length").over(every).alias("shortest"), F.max("length").over(every).alias("longest")).where("broken > 0")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_against_neighbours(r["length"], r["broken"], r["risk"], r["around"], r["shortest"], r["longest"], span) for r in batch.to_pylist()]
            expected, peak, p = zip(*rows) if rows else ((), (), ())
            added = [pa.array(expected, pa.float64()), pa.array(peak, pa.int64()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], ["length", "texts", "broken", "expected", "peak", "p"])

    tested = near.mapInArrow(test, "length int, texts long, broken long, expected double, peak long, p double")
    ranked = tested.withColumn("rank", F.row_number().over(every.orderBy("p", "length"))).withColumn("all", F.count(F.lit(1)).over(every))
    ranked = ranked.withColumn("passes", F.col("p") <= F.lit(rate) * F.col("rank") / F.col("all"))
    bound = ranked.withColumn("bound", F.max(F.when(F.col("passes"), F.col("p"))).over(every))
    chosen = (F.col("p") <= F.col("bound")) & (F.col("broken") >= least) & (F.col("broken") >= times * F.greatest("expected", "peak"))
    return bound.where(chosen).select("length", "texts", "broken", "expected", "p")


def truncated_texts(rows: DataFrame, *, id_col: str = "id", text_col: str = "shorty", extra: list[str] | None = None) -> DataFrame:
    """Rows whose text breaks off: (id, length, complete, at_limit, truncated, *extra), one per non-blank text.

    Texts that stop inside a word or sentence are truncated wherever they stop; at lengths that are significant
    field limits a doubtful ending is enough. Null and blank texts are left out; a text that closes its last sentence is
    never truncated. Repeated rows come out as often as they occur. An empty table gives no rows.
    """
    extra = extra or []
    filled = rows.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"(?U)\S")).select(
        F.col(id_col).cast("long").alias("id"), F.length(text_col).alias("length"), *extra, F.col(text_col).alias("_t")
    )
    counts = ending_counts(filled.select("_t"))
    judged = cut(with_completeness(filled, ["id", "length", *extra], "_t", counts))
    spikes = length_spikes(judged).select("length", F.lit(True).alias("_spike"))
    # the number of spikes is bounded by the lengths that occur
    out = judged.join(spikes, "length", "left")
    at_limit = F.coalesce("_spike", F.lit(False))
    truncated = (F.col("complete") < SURE) | (at_limit & (F.col("complete") < LIKELY))
    return out.select("id", "length", "complete", at_limit.alias("at_limit"), truncated.alias("truncated"), *extra)
