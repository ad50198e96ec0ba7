"""Matching and merging of text blocks: exact by occurrence, then refined by similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.distance import MATCH, with_matches


def block_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row a block: id, idx, normalized, start, end and the number of blocks."""
    cut = docs.select(id_column, T.blocks(F.col(text_column)).alias("bs"))
    return cut.select(id_column, F.inline(T.spans(F.col("bs"))), F.size("bs").alias("total"))


def block_scores(left: DataFrame, right: DataFrame, pair: str, text_column: str) -> DataFrame:
    """(pair, score): mean Jaccard of the words of blocks paired by number, over the larger number of blocks; no blocks at all are alike.

    Blocks are cut once and joined by number, so nothing nested is evaluated per pair.
    """
    cut = lambda side, name: side.select(pair, F.posexplode(T.blocks(F.col(text_column))).alias("idx", "b")).select(pair, "idx", F.array_distinct(F.split("b", " ")).alias(name))
    both = cut(left, "a").join(cut(right, "b"), [pair, "idx"], "full_outer")
    one = F.coalesce(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), F.lit(0.0))
    means = both.groupBy(pair).agg(F.avg(one).alias("score"))
    pairs = left.select(pair).join(right.select(pair), pair)
    return pairs.join(means, pair, "left").select(pair, F.coalesce("score", F.lit(1.0)).alias("score"))


def exact_pairs(template: DataFrame, destination: DataFrame, pair: str) -> DataFrame:
    """(pair, template_idx, destination_idx): the k-th occurrence of a block with the k-th one of the other side."""
    nth = lambda side, name: side.select(pair, "normalized", F.col("idx").alias(name), F.row_number().over(Window.partitionBy(pair, "normalized").orderBy("idx")).alias("k"))
    return nth(template, "template_idx").join(nth(destination, "destination_idx"), [pair, "normalized", "k"]).select(pair, "template_idx", "destination_idx")


def take_greedily(candidates: DataFrame, pair: str) -> DataFrame:
    """For each destination block in order the best template block still free; ties go to the earlier one.

    Sequential within a pair of texts, so each runs as a group of its scored pairs.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        ordered = rows.sort_values(["destination_idx", "score", "template_idx"], ascending=[True, False, True])
        for _, group in ordered.groupby("destination_idx", sort=True):
            free = group[~group.template_idx.isin(taken)]
            if len(free):
                taken.add(int(free.iloc[0].template_idx))
                out.append(free.iloc[0])
        return pd.DataFrame(out, columns=rows.columns).astype(rows.dtypes.to_dict())

    return candidates.groupBy(pair).applyInPandas(choose, candidates.schema)


def match_texts(pairs: DataFrame, pair: str) -> DataFrame:
    """(pair, template, destination, matches) of (pair, template, destination), arrays of the normalised blocks of two texts.

    Both texts stand in one row, so nothing is joined, shuffled or stored.  ``matches`` are
    MATCHes: exact ones by occurrence; then each destination block left over, in order,
    takes the best template block still free.
    """
    raw = pairs.select(pair, *[F.col(c).cast("array<binary>").alias(c) for c in ("template", "destination")])
    columns = ", ".join(f"`{c}` {t}" for c, t in raw.dtypes)
    return raw.mapInArrow(with_matches, f"{columns}, matches array<{MATCH}>")


def matches_of(matched: DataFrame, pair: str) -> DataFrame:
    """(pair, template_idx, destination_idx, phase, score), a row a match."""
    return matched.select(pair, F.inline("matches"))


def merged_texts(matched: DataFrame, pair: str) -> DataFrame:
    """(pair, merged): destination blocks in order, then template blocks that nothing matched; pairs without blocks have none."""
    free = F.array_except(F.transform("template", lambda _, i: i), F.transform("matches", lambda m: m["template_idx"]))
    parts = F.concat("destination", F.transform(free, lambda i: F.get(F.col("template"), i))).cast("array<string>")
    return matched.filter((F.size("template") > 0) | (F.size("destination") > 0)).select(pair, F.array_join(parts, "\n\n").alias("merged"))


def match_blocks(template: DataFrame, destination: DataFrame, pair: str) -> DataFrame:
    """(pair, template_idx, destination_idx, phase, score) of all matches between rows of blocks.

    The blocks of a pair's two texts come together in one shuffle, each text once.
    """
    cut = lambda side, part: side.select(pair, F.lit(part).alias("part"), "idx", "normalized")
    rows = F.array_sort(F.collect_list(F.struct("part", "idx", "normalized")))
    both = cut(template, 0).unionByName(cut(destination, 1)).groupBy(pair).agg(rows.alias("rows"))
    of = lambda part: F.transform(F.filter("rows", lambda r: r["part"] == part), lambda r: r["normalized"])
    return matches_of(match_texts(both.select(pair, of(0).alias("template"), of(1).alias("destination")), pair), pair)


def merge_blocks(template: DataFrame, destination: DataFrame, matches: DataFrame, pair: str) -> DataFrame:
    """(pair, merged): destination blocks in order, then template blocks that nothing matched."""
    free = template.join(matches.select(pair, F.col("template_idx").alias("idx")), [pair, "idx"], "left_anti")
    rows = destination.select(pair, F.lit(0).alias("part"), "idx", "normalized").unionByName(free.select(pair, F.lit(1).alias("part"), "idx", "normalized"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "idx", "normalized")))
    return rows.groupBy(pair).agg(F.array_join(F.transform(ordered, lambda r: r["normalized"]), "\n\n").alias("merged"))
