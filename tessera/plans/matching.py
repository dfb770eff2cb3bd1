"""Claims and windows of sentences that share enough words.

A few claims are sent to every task, which counts the words that they share
with each sentence of a batch, adds those of a window's sentences up, and
compares in full where the sum may reach the floor; so neither text nor pairs
below the floor are shuffled. More claims meet the windows by a join: a pair that shares ``t`` words of the shorter side's ``n`` shares one of its
``n - t + 1`` rarest, so only those meet the other side's words in an
equi-join, and frequent words bring nothing together. Pairs so found are
compared in full. Rows hold the units of one window at most, never a source's
whole array, so the work grows with a source's length and not its square.

claims: claim_id, words and numbers. units: source and units, an array of
structs with words and numbers. All words stand in one order, the rare first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.units import pieces
from tessera.storage import bounded

MIN_OVERLAP = 4
MIN_COEFFICIENT = 0.60
MAX_WINDOW = 3
MAX_BROADCAST_ROWS = 200_000
#: So many claims are met in batches at most, and so many counts of a unit and a claim are held at once.
MAX_CLAIMS = 4_096
MAX_CELLS = 2_000_000
#: Sources are looked at together up to so many units.
MAX_UNITS = 20_000


def _to_meet(size: Column) -> Column:
    """How many of the rarest words of a side of that size must hold a shared one, where it is the shorter side."""
    return (size - F.greatest(F.lit(MIN_OVERLAP), F.ceil(size * MIN_COEFFICIENT - 1e-6)) + 1).cast("int")


def near(units: DataFrame, *fields: str) -> DataFrame:
    """source, start and near: the fields of the unit at ``start`` and of those behind it that a window may hold."""
    slim = F.transform("units", lambda u: F.struct(*[u[f].alias(f) for f in fields]))
    return units.select("source", F.posexplode(F.transform(slim, lambda u, i: F.slice(slim, i + 1, MAX_WINDOW))).alias("start", "near"))


def _together(found: Column, width: Column, field: str) -> Column:
    return F.array_distinct(F.flatten(F.slice(found, F.lit(1), width)[field]))


def candidate_pairs(claims: DataFrame, units: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """claim_id, source, start and width of all pairs that may reach the floor."""
    asked = claims.select("claim_id", F.size("words").alias("claim_size"), "words")
    largest = claims.agg(F.max(F.size("words"))).first()[0] or 0

    # The claim is the shorter side, or as long: one of its rare words is in a sentence of the window.
    rare = asked.select("claim_id", F.explode(F.slice("words", F.lit(1), _to_meet(F.col("claim_size")))).alias("word"))
    told = units.select("source", F.posexplode("units").alias("position", "u")).select("source", "position", F.explode("u.words").alias("word"))
    met = told.join(bounded(rare, max_broadcast), "word").select("claim_id", "source", "position").distinct()
    reach = [F.struct(F.lit(back).alias("back"), F.lit(width).alias("width")) for width in range(1, MAX_WINDOW + 1) for back in range(width)]
    around = met.select("claim_id", "source", "position", F.explode(F.array(*reach)).alias("r")).where("position >= r.back")
    first = around.select("claim_id", "source", (F.col("position") - F.col("r.back")).alias("start"), "r.width")

    # The window is the shorter side: one of its rare words is in the claim. No sentence of it has more words than it.
    runs = near(units, "words").where(F.size(F.col("near")[0]["words"]) < largest).select("source", "start", "near", F.explode(F.sequence(F.lit(1), F.size("near"))).alias("width"))
    # An array of one, so that a window's words are put together once.
    worded = runs.select("source", "start", "width", F.explode(F.array(F.array_sort(_together(F.col("near"), F.col("width"), "words")))).alias("words")).where(F.size("words") < largest)
    sized = worded.select("source", "start", "width", F.size("words").alias("size"), F.explode(F.slice("words", F.lit(1), _to_meet(F.size("words")))).alias("word"))
    every = asked.select("claim_id", "claim_size", F.explode("words").alias("word"))
    second = sized.join(bounded(every, max_broadcast), "word").where("size < claim_size").select("claim_id", "source", "start", "width")
    return first.unionByName(second).distinct()


def scored_pairs(claims: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame:
    """claim_id, source, start, width and score of the pairs that reach the floor and hold the claim's numbers."""
    known = claims.select("claim_id", F.col("words").alias("cw"), F.col("numbers").alias("cn"))
    met = pairs.join(near(units, "words", "numbers"), ["source", "start"]).where("width <= size(near)").join(known, "claim_id")
    both = met.select("claim_id", "source", "start", "width", "cw", "cn", *[_together(F.col("near"), F.col("width"), f).alias(f) for f in ("words", "numbers")])
    fit = both.where(F.size(F.array_except("cn", "numbers")) == 0)
    shared = fit.select("claim_id", "source", "start", "width", F.size(F.array_intersect("cw", "words")).alias("shared"), F.least(F.size("cw"), F.size("words")).alias("least"))
    scored = shared.where(F.col("shared") >= MIN_OVERLAP).select("claim_id", "source", "start", "width", (F.col("shared") / F.col("least")).alias("score"))
    return scored.where(F.col("score") >= MIN_COEFFICIENT)


def _least_shared(size: np.ndarray) -> np.ndarray:
    """How many words a pair must share whose shorter side has that size."""
    return np.maximum(MIN_OVERLAP, np.ceil(size * MIN_COEFFICIENT - 1e-6)).astype(np.int64)


def _windows_of(claims: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows (source, units) as the pairs that :func:`scored_pairs` gives, in blocks of units of bounded size."""
    ids, asked, numbers = (claims.column(c).combine_chunks() for c in ("claim_id", "words", "numbers"))
    vocabulary = pc.unique(pc.list_flatten(asked))
    sizes = pc.list_value_length(asked).to_numpy(zero_copy_only=False)
    needed = _least_shared(sizes)
    places = pc.index_in(pc.list_flatten(asked), vocabulary).to_numpy(zero_copy_only=False)
    order = np.argsort(places, kind="stable")
    #: The claims that hold each word, word after word.
    holders = pc.list_parent_indices(asked).to_numpy(zero_copy_only=False)[order]
    held = np.bincount(places, minlength=len(vocabulary))
    first = np.cumsum(held) - held
    own = [set(w.tolist()) for w in np.split(places, np.cumsum(sizes)[:-1])]
    figures = [set(n) for n in numbers.to_pylist()]
    block = max(MAX_CELLS // len(ids), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, pc.list_value_length(whole.column(1)).to_pylist(), MAX_UNITS)):
            units = batch.column(1)
            owner = pc.list_parent_indices(units).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(units)
            words, told = pc.struct_field(flat, "words"), pc.struct_field(flat, "numbers")
            length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(length)])
            each = pc.list_flatten(words)
            codes = each.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            known = pc.fill_null(pc.index_in(each, vocabulary), -1).to_numpy(zero_copy_only=False)
            at = np.arange(len(owner)) - np.searchsorted(owner, owner)
            found = []
            for a in range(0, len(owner), block):
                b = min(a + block + MAX_WINDOW - 1, len(owner))
                word = known[ends[a] : ends[b]]
                unit = np.repeat(np.arange(b - a), length[a:b])[word >= 0]
                word = word[word >= 0]
                times = held[word]
                shift = np.repeat(first[word] - (np.cumsum(times) - times), times)
                cells = np.repeat(unit, times) * len(ids) + holders[shift + np.arange(len(shift))]
                shared = np.bincount(cells, minlength=(b - a) * len(ids)).astype(np.int32).reshape(b - a, len(ids))
                starts = min(block, len(owner) - a)
                total, longest = shared[:starts], length[a : a + starts]
                for width in range(1, MAX_WINDOW + 1):
                    if width > 1:
                        starts = min(starts, b - a - width + 1)
                        if starts <= 0:
                            break
                        total = total[:starts] + shared[width - 1 : width - 1 + starts]
                        longest = np.maximum(longest[:starts], length[a + width - 1 : a + width - 1 + starts])
                    whole = owner[a : a + starts] == owner[a + width - 1 : a + width - 1 + starts]
                    # No window has fewer words than its longest sentence, nor shares more than its sentences do together.
                    may = (total >= needed) | (total >= _least_shared(longest)[:, None])
                    may &= whole[:, None]
                    for start, claim in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
                        i = a + start
                        both = len(own[claim].intersection(known[ends[i] : ends[i + width]].tolist()))
                        if both < MIN_OVERLAP:
                            continue
                        score = both / min(len(own[claim]), len(set(codes[ends[i] : ends[i + width]].tolist())))
                        if score >= MIN_COEFFICIENT and (not figures[claim] or figures[claim].issubset(n for j in range(i, i + width) for n in told[j].as_py())):
                            found.append((claim, owner[i], at[i], width, score))
            claim, row, start, width, score = zip(*found, strict=True) if found else ([],) * 5
            columns = [ids.take(pa.array(claim, pa.int64())), batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(width, pa.int32()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["claim_id", "source", "start", "width", "score"])

    return run


def few_claims(claims: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> pa.Table | None:
    """The claims that have words, where they are few enough to be sent to every task; None where they are not, or there is none."""
    asked = claims.where(F.size("words") > 0).select("claim_id", "words", "numbers")
    count, words = asked.agg(F.count("*"), F.sum(F.size("words"))).first()
    return None if not count or count > MAX_CLAIMS or words > max_broadcast else asked.toArrow()


def _pairs_schema(claims: DataFrame, sources: DataFrame) -> str:
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((claims, "claim_id"), (sources, "source"))]
    return f"claim_id {kinds[0]}, source {kinds[1]}, start int, width int, score double"


def pairs_of_texts(claims: DataFrame, few: pa.Table, texts: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """:func:`fitting_pairs` of few claims and the units that ``read`` makes of batches of ``texts`` (source and others), in one pass."""
    meet = _windows_of(few)
    return texts.mapInArrow(lambda batches: meet(read(batches)), _pairs_schema(claims, texts))


def fitting_pairs(claims: DataFrame, units: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """claim_id, source, start, width and score of the claims and windows that reach the floor, the claim's numbers among the window's.

    Claims with ``max_broadcast`` words or fewer meet the windows in batches, others by :func:`candidate_pairs`.
    """
    few = few_claims(claims, max_broadcast)
    if few is None:
        return scored_pairs(claims, units, candidate_pairs(claims, units, max_broadcast))
    slim = units.select("source", F.transform("units", lambda u: F.struct(u["words"].alias("words"), u["numbers"].alias("numbers"))).alias("units"))
    return slim.mapInArrow(_windows_of(few), _pairs_schema(claims, units))


def best_of(pairs: DataFrame) -> DataFrame:
    """Each claim's best of the pairs: the highest score, then the narrower, the smaller source, the earlier one."""
    rank = F.struct((-F.col("score")).alias("score"), "width", "source", "start")
    return pairs.groupBy("claim_id").agg(F.min(rank).alias("b")).select("claim_id", "b.source", "b.start", "b.width", (-F.col("b.score")).alias("score"))


def best_pairs(claims: DataFrame, units: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Each claim's best window; none below the floor."""
    return best_of(fitting_pairs(claims, units, max_broadcast))


def gained_pairs(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Each claim's best of the pairs, where that is in another source than its best one in the sources of ``held`` (source)."""
    rank = F.struct((-F.col("score")).alias("score"), "width", "source", "start")
    marked = pairs.join(held.select("source", F.lit(True).alias("held")), "source", "left")
    best = marked.groupBy("claim_id").agg(F.min(rank).alias("b"), F.min(F.when(F.col("held"), rank)).alias("h")).where(~F.col("b.source").eqNullSafe(F.col("h.source")))
    return best.select("claim_id", "b.source", "b.start", "b.width", (-F.col("b.score")).alias("score"))


def missed_sentences(claims: DataFrame, sentences: DataFrame, most: int, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """claim_id, rank, source, position and score of the sentences (source, position, words) nearest to each claim below the floor.

    Both share ``MIN_OVERLAP`` words, and the first that they share, in order
    of rarity, has at least ``MIN_OVERLAP - 1`` behind it on either side: words
    nearer to a side's end bring nothing together.
    """
    rare = lambda words: F.explode(F.slice(words, F.lit(1), F.size(words) - (MIN_OVERLAP - 1)))
    told = sentences.where(F.size("words") >= MIN_OVERLAP)
    asked = claims.where(F.size("words") >= MIN_OVERLAP).select("claim_id", rare(F.col("words")).alias("word"))
    pairs = told.select("source", "position", rare(F.col("words")).alias("word")).join(bounded(asked, max_broadcast), "word").select("claim_id", "source", "position").distinct()
    met = pairs.join(told.select("source", "position", "words"), ["source", "position"]).join(claims.select("claim_id", F.col("words").alias("cw")), "claim_id")
    shared = F.size(F.array_intersect("cw", "words"))
    scored = met.where(shared >= MIN_OVERLAP).select("claim_id", "source", "position", (shared / F.least(F.size("cw"), F.size("words"))).alias("score"))
    # Spark keeps the first rows of each claim before the shuffle, so no task orders all of a claim's pairs.
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("score"), "source", "position"))
    return scored.where(F.col("score") < MIN_COEFFICIENT).withColumn("rank", place).where(F.col("rank") <= most)
