"""Matches of regular expressions with their places, by Spark functions alone.

Places are code points, end exclusive. A text is split at the matches, and the lengths of gaps and
matches are added up; so one pass over the matches gives all places, and texts without a match (told by a cheap
filter) cost nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,m:string,v:string>"


def found(text: Column, pattern: str, may: Column, group: int = 0) -> Column:
    """``{m: matches, v: their group, g: gaps}``, or null where ``may`` says that there is none.

    Patterns must not match the empty string.
    """
    return F.when(
        may,
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
            F.split(text, pattern, -1).alias("g"),
        ),
    )


def placed(name: str) -> Column:
    """Spans ``{s, e, m, v}`` of a column made by ``found``; empty for null."""
    return F.expr(f"""
        if({name} is null, cast(array() as array<{SPAN}>), aggregate(
            transform({name}.m, (m, i) -> named_struct('g', {name}.g[i], 'm', m, 'v', {name}.v[i])),
            named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
            (a, x) -> named_struct('at', a.at + length(x.g) + length(x.m), 'out', concat(a.out, array(
                named_struct('s', a.at + length(x.g), 'e', a.at + length(x.g) + length(x.m), 'm', x.m, 'v', x.v)))),
            a -> a.out))""")


def listed(kinds: list[str], column) -> Column:
    """``kind:start:end`` of spans in order of start, then kind as listed, comma-joined.

    ``column(kind)``: the array of spans ``{s, e, ...}`` of a kind.
    """

    def marked(i: int) -> Column:
        return F.transform(column(kinds[i]), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    named = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.concat(*map(marked, range(len(kinds)))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(named, x["k"] + 1), x["s"], x["e"])), ",")
