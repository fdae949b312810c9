"""Constituents that start and end at the words of bracketed trees."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators.relations import place_spans

_PART = re.compile(r"[()]|[^\s()]+")
EMPTY = "-NONE-"  # fixed value: label of empty elements


def leaves(tree: str) -> list[tuple[str, int, int]]:
    """(token, constituents that end there, constituents that start there) of each leaf.

    One scan with a stack. Empty elements, and constituents that hold nothing else, are left
    out; a constituent counts if another node is inside it.
    """
    out: list[list] = []
    stack: list[list] = []  # label, first leaf, whether a kept node is inside
    want = False
    for part in _PART.findall(tree):
        if part == "(":
            stack.append(["", len(out), False])
            want = True
        elif part == ")":
            if not stack:
                continue
            label, first, inner = stack.pop()
            want = False
            if len(out) > first:  # something is left of it
                if inner:
                    out[-1][1] += 1
                    out[first][2] += 1
                if stack:
                    stack[-1][2] = True
        elif want:
            stack[-1][0], want = part, False
        elif stack and stack[-1][0] != EMPTY:
            out.append([part.split("/")[0] if "/" in part else part, 0, 0])
    return [tuple(x) for x in out]


def closures(trees: DataFrame, keys: list[str], tree: str = "tree") -> DataFrame:
    """``keys, leaf, token, closings, openings`` of every leaf of every tree; each tree is on its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [leaves(t or "") for t in f[tree]]
            size = [len(x) for x in found]
            out = {k: f[k].repeat(size).array for k in keys} | {"leaf": [i for n in size for i in range(n)]}
            yield pd.DataFrame(out | {name: [leaf[at] for x in found for leaf in x] for at, name in enumerate(("token", "closings", "openings"))})

    kinds = dict(trees.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "leaf int", "token string", "closings int", "openings int"])
    return trees.select(*keys, tree).mapInPandas(run, schema)


def closure_depth(words: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos, depth``: closings summed over the leaves inside each word.

    ``words`` has ``keys, pos, word``, ``found`` has ``keys, at, token, closings`` (at: order of the
    leaves). The two meet by cumulative lengths.
    """
    rank = found.schema["at"].dataType
    a = words.select(*keys, F.lit(True).alias("is_word"), "pos", F.lit(None).cast(rank).alias("at"), F.length("word").alias("n"), F.lit(None).cast("int").alias("closings"))
    b = found.select(*keys, F.lit(False).alias("is_word"), F.lit(None).cast(words.schema["pos"].dataType).alias("pos"), "at", F.length("token").alias("n"), "closings")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.unionByName(b).repartition(parts, *keys)  # dealt once; all that follows keeps to it
    end = F.sum("n").over(Window.partitionBy(*keys, "is_word").orderBy("pos", "at"))
    spans = both.select(*keys, "is_word", "pos", "closings", (end - F.col("n")).alias("start"), end.alias("end"))
    placed = place_spans(spans, keys, F.col("is_word"), "start", "end", ["pos"])
    return placed.groupBy(*keys, F.col("word_pos").alias("pos")).agg(F.sum("closings").alias("depth"))
