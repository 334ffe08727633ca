"""Comparison of result sets in long form, one row a cell: no set has to fit a cell.

Same rules as :func:`tallyframe.operators.compare.compare_rows`, for sets of any
size. Shapes decide what they can; of the rest, column signatures (rows, nulls,
numbers, an order-free hash of the texts, smallest and largest number) name the pairs
of columns that may match. Where row order counts, whole rows are ranked and joined.
Elsewhere columns of texts, and columns whose cells hash alike, are compared as bags by
counting every cell, and only columns with numbers that are no equal bags are ranked and
joined cell by cell. Ranks come from range partitions, so a set or a constant column with
a third of all cells spreads like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.values import ABS_TOLERANCE, cells_equal, numbers_close
from tallyframe.operators.ordering import rank_within
from tallyframe.session import materialize

_HASH_BASE = 1 << 31


def _shapes(rows: DataFrame) -> DataFrame:
    """(set_id, n, width, ragged): the width is the first row's; a shorter row makes a set ragged."""
    size = F.size("cells")
    return rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(size, "row_no").alias("width"),
                                      F.min(size).alias("_least")).select("set_id", "n", "width",
                                                                          (F.col("_least") < F.col("width")).alias("ragged"))


def _signatures(cells: DataFrame) -> DataFrame:
    """What two columns must share to match, whatever the order of their rows."""
    cell, number = F.col("cell"), F.when(F.col("cell.is_num"), F.col("cell.num"))
    text = F.when(~cell["is_null"] & ~cell["is_num"], F.xxhash64(cell["text"]))
    whole = F.xxhash64(*_identity(cell))
    return cells.groupBy("set_id", "place").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(cell["is_null"]).alias("nulls"), F.count_if(cell["is_num"]).alias("numbers"),
        F.coalesce(F.sum(F.pmod(text, F.lit(_HASH_BASE))), F.lit(0)).alias("texts"), F.coalesce(F.bit_xor(text), F.lit(0)).alias("mixed"),
        F.sum(F.pmod(whole, F.lit(_HASH_BASE))).alias("bag"), F.min(number).alias("low"), F.max(number).alias("high"))


def _identity(cell: Column) -> list[Column]:
    """What makes a cell; all nulls are one."""
    return [F.coalesce(cell["is_null"], F.lit(True)).alias("is_null"),
            *[F.when(~cell["is_null"], cell[c]).alias(c) for c in ("text", "is_num", "num")]]


def _sort_key(order: str) -> Column:
    """Place of a cell in its column: canonical order, ties by row."""
    cell = F.col("cell")
    keys = {"text": [cell["is_null"], cell["text"], cell["is_num"], cell["num"]],
            "numeric": [cell["is_null"], ~cell["is_num"], cell["num"], cell["text"]]}[order]
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("row_no"))


def compare_long(pairs: DataFrame, predicted: DataFrame, gold: DataFrame, *, order: str = "text",
                 tolerance: float = ABS_TOLERANCE) -> DataFrame:
    """(index, same) for pairs (index, gold_id, ordered).

    ``predicted`` holds (index, row_no, cells) and ``gold`` (gold_id, row_no, cells);
    row numbers are unique within a set. A set without rows is empty.
    """
    asked = materialize(pairs.select("index", F.concat(F.lit("g"), F.col("gold_id")).alias("gold_set"),
                                     F.concat(F.lit("p"), F.col("index").cast("string")).alias("pred_set"), "ordered"), "pairs")
    rows = materialize(gold.select(F.concat(F.lit("g"), F.col("gold_id")).alias("set_id"), "row_no", "cells").unionByName(
        predicted.select(F.concat(F.lit("p"), F.col("index").cast("string")).alias("set_id"), "row_no", "cells")), "sets")
    shapes = _shapes(rows)

    def side(name: str) -> DataFrame:
        return shapes.select(F.col("set_id").alias(f"{name}_set"), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "width", "ragged")])
    shaped = asked.join(side("gold"), "gold_set", "left").join(side("pred"), "pred_set", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("gold_n", "pred_n")})
    empty = (F.col("gold_n") == 0) | (F.col("pred_n") == 0)
    shaped = materialize(shaped.withColumn("decided", F.when(empty, F.col("gold_n") == F.col("pred_n"))
                                           .when((F.col("gold_n") != F.col("pred_n")) | F.col("gold_ragged") | F.col("pred_ragged"), False)
                                           .when(F.col("gold_width") == 0, True).when(F.col("pred_width") == 0, False)), "shaped")
    still = shaped.where("decided IS NULL")
    sets = still.select(F.col("gold_set").alias("set_id")).unionByName(still.select(F.col("pred_set").alias("set_id"))).distinct()
    cells = rows.join(sets, "set_id").select("set_id", "row_no", F.posexplode("cells").alias("place", "cell"))
    found = _column_pairs(still, _signatures(cells), tolerance)
    names = ["index", "gold_place", "pred_place"]
    loose = found.where(~F.col("ordered"))
    alike = materialize(_equal_bags(loose.where((F.col("numbers") == 0) | (F.col("gold_bag") == F.col("pred_bag"))), cells), "alike")
    near = _match(loose.where(F.col("numbers") > 0).join(alike, names, "left_anti"), cells, order, tolerance)
    matched = alike.unionByName(near).unionByName(_match_rows(found.where("ordered"), rows, tolerance))
    # Every gold column must match some predicted one.
    columns = matched.groupBy("index").agg(F.count_distinct("gold_place").alias("matched"))
    judged = shaped.join(columns, "index", "left")
    return judged.select("index", F.coalesce("decided", F.coalesce("matched", F.lit(0)) == F.col("gold_width")).alias("same"))


def _column_pairs(still: DataFrame, signatures: DataFrame, tolerance: float) -> DataFrame:
    """(index, ordered, gold_set, gold_place, pred_set, pred_place, n, numbers, bags) of columns whose signatures agree."""
    exact = ["n", "nulls", "numbers", "texts", "mixed"]

    def side(name: str) -> DataFrame:
        return signatures.select(F.col("set_id").alias(f"{name}_set"), F.col("place").alias(f"{name}_place"), *exact,
                                 *[F.col(c).alias(f"{name}_{c}") for c in ("low", "high", "bag")])
    golds = still.join(side("gold"), "gold_set").where((F.col("gold_place") < F.col("gold_width")) & (F.col("n") == F.col("gold_n")))
    both = golds.join(side("pred"), ["pred_set", *exact]).where(F.col("pred_place") < F.col("pred_width"))
    near = [F.col(f"gold_{c}").isNull() | numbers_close(F.col(f"gold_{c}"), F.col(f"pred_{c}"), tolerance) for c in ("low", "high")]
    return materialize(both.where(near[0] & near[1]).select("index", "ordered", "gold_set", "gold_place", "pred_set", "pred_place", "n", "numbers",
                                                            "gold_bag", "pred_bag"), "column-pairs")


def _equal_bags(found: DataFrame, cells: DataFrame) -> DataFrame:
    """(index, gold_place, pred_place) of the pairs that hold the same cells equally often, in whatever order."""
    names = ["index", "gold_place", "pred_place"]

    def side(name: str, sign: int) -> DataFrame:
        return found.select(*names, F.col(f"{name}_set").alias("set_id"), F.col(f"{name}_place").alias("place"), F.lit(sign).alias("sign"))
    both = side("gold", 1).unionByName(side("pred", -1)).join(cells, ["set_id", "place"])
    values = both.select(*names, "sign", *_identity(F.col("cell")))
    odd = ~F.col("is_null") & F.coalesce(F.when(F.col("is_num"), F.col("num").isNull() | F.isnan("num")).otherwise(F.col("text").isNull()), F.lit(True))
    counted = values.groupBy(*names, "is_null", "text", "is_num", "num").agg(F.sum("sign").alias("more"))
    # A cell that is not even equal to itself, such as NaN, makes its column unequal.
    return counted.groupBy(*names).agg(F.bool_and((F.col("more") == 0) & ~odd).alias("equal")).where("equal").select(*names)


def _match_rows(found: DataFrame, rows: DataFrame, tolerance: float) -> DataFrame:
    """(index, gold_place, pred_place) of the pairs whose cells are equal row by row, in the order of the rows."""
    wanted = found.select(F.col("gold_set").alias("set_id")).unionByName(found.select(F.col("pred_set").alias("set_id"))).distinct()
    ranked = materialize(rank_within(rows.join(wanted, "set_id"), ["set_id"], "row_no", "rank").select("set_id", "rank", "cells"), "ranked-rows")

    def side(name: str) -> DataFrame:
        return ranked.select(F.col("set_id").alias(f"{name}_set"), "rank", F.col("cells").alias(f"{name}_cells"))
    asked = found.groupBy("index", "gold_set", "pred_set").agg(F.max("n").alias("n"), F.collect_list(F.struct("gold_place", "pred_place")).alias("places"))
    paired = asked.join(side("gold"), "gold_set").join(side("pred"), ["pred_set", "rank"])
    cells = paired.select("index", "n", "gold_cells", "pred_cells", F.explode("places").alias("at"))
    equal = cells_equal(F.get("gold_cells", F.col("at.gold_place")), F.get("pred_cells", F.col("at.pred_place")), tolerance)
    return (cells.groupBy("index", "at.gold_place", "at.pred_place").agg(F.bool_and(F.coalesce(equal, F.lit(False))).alias("equal"),
                                                                         F.count(F.lit(1)).alias("pairs"), F.max("n").alias("n"))
            .where(F.col("equal") & (F.col("pairs") == F.col("n"))).select("index", "gold_place", "pred_place"))


def _match(found: DataFrame, cells: DataFrame, order: str, tolerance: float) -> DataFrame:
    """(index, gold_place, pred_place) of the pairs whose cells are equal rank by rank."""
    wanted = found.select(F.col("gold_set").alias("set_id"), F.col("gold_place").alias("place")).unionByName(
        found.select(F.col("pred_set").alias("set_id"), F.col("pred_place").alias("place"))).distinct()
    ranked = rank_within(cells.join(wanted, ["set_id", "place"]).select("set_id", "place", "cell", _sort_key(order).alias("key")),
                         ["set_id", "place"], "key", "rank")
    ranked = materialize(ranked.select("set_id", "place", "rank", "cell"), "ranked")

    def side(name: str) -> DataFrame:
        return ranked.select(F.col("set_id").alias(f"{name}_set"), F.col("place").alias(f"{name}_place"), "rank", F.col("cell").alias(f"{name}_cell"))
    paired = found.join(side("gold"), ["gold_set", "gold_place"]).join(side("pred"), ["pred_set", "pred_place", "rank"])
    equal = cells_equal(F.col("gold_cell"), F.col("pred_cell"), tolerance)
    return (paired.groupBy("index", "gold_place", "pred_place").agg(F.bool_and(F.coalesce(equal, F.lit(False))).alias("equal"),
                                                                    F.count(F.lit(1)).alias("pairs"), F.max("n").alias("n"))
            .where(F.col("equal") & (F.col("pairs") == F.col("n"))).select("index", "gold_place", "pred_place"))
