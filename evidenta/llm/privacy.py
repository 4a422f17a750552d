"""Personal data by patterns and bootstrapped contextual extraction, by Spark functions alone.

Patterns give the base spans (email, ip, card, phone). Their values are the seed instances. An instance has lexical
patterns of two forms: the two words left of it, and its own word shape (letters and digits masked, as they are and
with runs shortened). Instances and patterns form a graph that is scored in rounds until nothing changes: a pattern's confidence is
the smoothed share of all its occurrences in the corpus (for words on the left, at any place where an
instance could start) that known instances have; it needs a least number of different instances, and a shape, which says less, a higher share.
Only seeds count for a shape: one learned from accepted tokens alone would take every token of that form, whatever the words on its left say.
An unknown identifier-like token is accepted once the chance that all its patterns are wrong falls below a bound, and
joins the instances of the next round. Accepted tokens are added as spans of kind ``context``; base spans stay.

A token is a run of letters and digits, joined by ``. _ @ + -``, of at least ``LEAST_LENGTH`` code points with a digit.

Texts are never shuffled: rows of instances and candidates are. Occurrences of words on the left are counted in one scan
of the texts by the few patterns that enough instances share; without any, that scan does not
happen. Shapes are counted from the candidates themselves. Patterns are broadcast, and their first words listed in the
scan, only while their number is within a bound, else counts are joined by shuffle.

Defined cases: a null text is empty; a null ``doc_id`` is carried; repeated rows are scanned each, and
equal values count once; an empty table gives no row; other columns are ignored. A text may have any length: matching is
linear, and words on the left are found however far away they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenta.llm.common import Scratch, quoted
from evidenta.llm.spans import found, listed, placed

KINDS = ["email", "ip", "card", "phone"]
# Each matches as the plain pattern does; lookbehind and possessive repeats only avoid retries inside a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A token with a digit: letters and digits, joined by . _ @ + -
IDENTIFIER = r"(?<![A-Za-z0-9])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9]++(?:[._@+-]++[A-Za-z0-9]++)*+"
LEAST_LENGTH = 5
LEAST_VALUES = 3  # different known instances that a lexical pattern needs
CONFIDENT, SHAPE_CONFIDENT = 0.5, 0.6  # share of a pattern's occurrences that known instances have
ACCEPT = 0.5  # an instance's chance of being one
REACH = 64  # code points left of a span in which its two words are sought first, then further away
MOST_BROADCAST = 20_000  # lexical patterns, of two hashes each
SPACE = r"\\x20\\x09-\\x0D"  # in SQL
# Places inside a word where an identifier, a card, an ip, a phone or an email could start.
INSIDE = (
    r"(?<=[^\x20\x09-\x0DA-Za-z0-9])(?=[A-Za-z0-9])|(?<=[^\x20\x09-\x0D0-9])(?=[0-9])|(?<=[^\x20\x09-\x0D])(?=\+[0-9])"
    r"|(?<=[^\x20\x09-\x0DA-Za-z0-9._%+-])(?=[._%+-])"
)
CHAINED = r"(?<=[A-Za-z0-9-])(?=[._%+])"  # right after an email


def _digits(column: str) -> str:
    return f"regexp_replace({column}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """SQL of the Luhn test of a string of at most 19 digits."""
    return f"""aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, int(substr({d}, -i, 1)),
        int(substr({d}, -i, 1)) * 2 - if(int(substr({d}, -i, 1)) > 4, 9, 0))) % 10 = 0"""


def base(t: Column) -> list[Column]:
    """Columns ``f_<kind>`` for ``placed``."""
    return [
        found(t, EMAIL, t.contains("@")).alias("f_email"),
        found(t, IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]")).alias("f_ip"),
        found(t, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")).alias("f_card"),
        found(t, PHONE, t.rlike(r"\+[0-9][\x20().0-9-]")).alias("f_phone"),
    ]


def valid(kind: str) -> Column:
    """The spans of ``all_<kind>`` that pass the test of their kind."""
    if kind == "ip":
        return F.expr("filter(all_ip, x -> forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and int('0' || substr(ltrim('0', p), 1, 3)) <= 255))")
    if kind == "card":
        return F.expr(f"filter(all_card, x -> length({_digits('x.m')}) between 14 and 19 and {_luhn(_digits('x.m'))})")
    if kind == "phone":
        return F.expr(f"filter(all_phone, x -> length({_digits('x.m')}) between 10 and 15)")
    return F.col(f"all_{kind}")


def _masked(text: str) -> str:
    return f"translate(lower({text}), '123456789', '000000000')"


def _context(start: str) -> str:
    """SQL: the two words left of a place, in lower case with digits masked; empty if there are not two.

    The last word ends at white space or at the place itself. They are sought in ever longer cuts of the
    text; a cut counts only if it shows where the first word begins.
    """

    def within(reach: str) -> str:
        left = f"substr(t, greatest({start} - {reach}, 0) + 1, least({start}, {reach}))"
        two = r"([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+)[\\x20\\x09-\\x0D]*$"
        begin = f"if({start} <= {reach}, '(?:^|[{SPACE}])', '[{SPACE}]')"
        return f"nullif(regexp_extract({_masked(left)}, concat({begin}, '{two}'), 1), '')"

    words = f"coalesce({within(str(REACH))}, {within(str(REACH * REACH))}, {within(f'greatest({start}, 1)')}, '')"
    return f"regexp_replace({words}, '[{SPACE}]+', ' ')"


def _seen(docs: DataFrame, text_col: str, wanted: DataFrame, n: int, most: int, scratch: Scratch | None = None) -> DataFrame:
    """``pattern, n_seen``: the places where an instance could start, after the ``n`` wanted patterns (``pattern, first``).

    Such places are after any two words, and inside a word where ``INSIDE`` says; for the latter only patterns of at most
    ``most`` code points, the longest wanted, are made, since a word has as many prefixes as places.
    """
    def small(some: DataFrame) -> DataFrame:
        return F.broadcast(some) if n <= MOST_BROADCAST else some

    def words(text: str) -> Column:
        return F.expr(f"split(trim(regexp_replace({text}, '[{SPACE}]+', ' ')), ' ')")

    # lower case can depend on what follows in a word, so words are cut before
    rows = docs.select(words(_masked(f"`{text_col}`")).alias("w"), words(f"`{text_col}`").alias("raw")).where("size(w) > 1")
    zipped = F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"), F.expr("slice(raw, 2, size(raw) - 1)").alias("raw"))
    pairs = rows.select(F.explode(zipped).alias("p")).select(F.xxhash64("p.a").alias("first"), "p.a", "p.b", "p.raw")
    # few pairs begin like a wanted pattern; equal ones are counted before their places are made
    firsts = wanted.select("first").distinct()
    if n <= MOST_BROADCAST:
        pairs = pairs.where(F.col("first").isin([r["first"] for r in firsts.collect()]))
    pairs = pairs.groupBy("first", "a", "b", "raw").agg(F.count("*").alias("n"))
    if n > MOST_BROADCAST:
        # not a semi-join, which Spark would move below the counts
        pairs = pairs.join(firsts, "first")
    # saved, else Spark moves what it infers from the places below the counts, to each occurrence of a pair
    pairs = (scratch or Scratch(docs.sparkSession, "privacy")).save(pairs.drop("first"), "pairs")
    split = F.when(F.col("raw").contains("@"), F.split("raw", f"{INSIDE}|{CHAINED}", -1)).otherwise(F.split("raw", INSIDE, -1))
    ends = f"""aggregate(slice(cut, 1, size(cut) - 1), named_struct('at', 0, 'out', cast(array() as array<int>)), (x, c) -> named_struct(
        'at', x.at + length(c), 'out', if(length(a) + 1 + x.at + length(c) <= {most}, array_append(x.out, x.at + length(c)), x.out)), x -> x.out)"""
    cut = pairs.select("a", "b", "raw", "n", split.alias("cut")).select("a", "b", "raw", "n", F.expr(ends).alias("ends"))
    inside = f"transform(ends, e -> {_masked('substr(raw, 1, e)')})"
    held = cut.select("n", F.expr(f"transform(concat(array(b), {inside}), e -> xxhash64(concat(a, ' ', e)))").alias("patterns"))
    if n <= MOST_BROADCAST:
        chosen = [r["pattern"] for r in wanted.select("pattern").collect()]
        held = held.select("n", F.filter("patterns", lambda x: x.isin(chosen)).alias("patterns"))
    places = held.select("n", F.explode("patterns").alias("pattern"))
    # counted before they are joined, so that the join gives a row a pattern and not a row a place
    return places.groupBy("pattern").agg(F.sum("n").alias("n_seen")).join(small(wanted.select("pattern")), "pattern")


def _shape(value: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({value}, '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '0')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", withheld: float = 0.0) -> DataFrame:
    """One row per document: counts, ``base_sha256``, ``spans``, ``n_context`` and ``n_found``, the number of all spans.

    ``withheld``: the share of base values, drawn by hash, that are no seeds but candidates, for measuring what the
    bootstrap discovers; their base spans stay and ``n_withheld`` counts them.
    """
    scratch = Scratch(docs.sparkSession, "privacy")
    t = F.col("t")
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", *base(t), found(t, IDENTIFIER, t.rlike("[0-9]")).alias("f_token"))
    rows = rows.select("doc_id", "t", *[placed(f"f_{k}").alias(f"all_{k}") for k in KINDS], F.expr(
        f"if(f_token is null or not exists(f_token.m, x -> length(x) >= {LEAST_LENGTH}), null, f_token)").alias("f_token"))
    rows = rows.select("doc_id", "t", *[valid(k).alias(k) for k in KINDS], placed("f_token").alias("all_token"))
    clash = " or ".join(f"exists({k}, y -> y.s < x.e and x.s < y.e)" for k in KINDS)
    rows = rows.select("doc_id", "t", *KINDS, F.expr(f"if(size(all_token) = 0, all_token, filter(all_token, x -> length(x.m) >= {LEAST_LENGTH} and not ({clash})))").alias("token"))

    def with_context(name: str, known: str) -> str:
        return f"transform({name}, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'left', {_context('x.s')}, 'known', {known}))"

    seed = f"pmod(xxhash64(x.m, 5), 1000) >= {int(1000 * withheld)}" if withheld else "true"
    rows = rows.select("doc_id", *KINDS, F.expr("concat(" + ", ".join([*(with_context(k, seed) for k in KINDS), with_context("token", "false")]) + ")").alias("x"))
    # a pattern is kept as its hash; that of words on the left also as that of its first word, and its length
    left = "named_struct('pattern', xxhash64(x.left), 'first', xxhash64(substring_index(x.left, ' ', 1)), 'long', length(x.left))"
    shapes = ", ".join(f"named_struct('pattern', xxhash64('shape', {v}), 'first', cast(null as bigint), 'long', 0)" for v in (_shape("x.m"), f"regexp_replace({_shape('x.m')}, '(.)\\\\1+', '$1')"))
    rows = rows.select("doc_id", *KINDS, F.expr(
        f"transform(x, x -> named_struct('s', x.s, 'e', x.e, 'value', sha2(x.m, 256), 'known', x.known, 'patterns', concat(if(x.left = '', array(), array({left})), array({shapes}))))").alias("instances"))
    # rows without texts; the row number tells repeated rows apart
    held = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "found")
    flat = held.select("row", F.explode("instances").alias("x")).select("row", "x.*")
    links = flat.select("value", "known", F.explode("patterns").alias("p")).select("value", "known", "p.*")
    accepted = _bootstrap(docs.select(F.col(quoted(text_col)).alias("t")).where("t is not null"), links, scratch)
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    if accepted is None:
        whole = held.withColumn("context", none)
    else:
        more = flat.where("not known").join(accepted, "value").groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("context"))
        whole = held.join(more, "row", "left").withColumn("context", F.coalesce("context", none))
    counts = [F.size(k).cast("long") for k in KINDS]
    extra = [F.size(F.expr(f"filter(instances, x -> not x.known and exists(concat({', '.join(KINDS)}), y -> y.s = x.s and y.e = x.e))")).cast("long").alias("n_withheld")] if withheld else []
    return whole.select(
        "doc_id", *[c.alias(f"n_{k}") for c, k in zip(counts, KINDS, strict=True)], F.sha2(listed(KINDS, F.col), 256).alias("base_sha256"),
        listed([*KINDS, "context"], F.col).alias("spans"), F.size("context").cast("long").alias("n_context"), (sum(counts[1:], counts[0]) + F.size("context")).cast("long").alias("n_found"), *extra,
    )


def _bootstrap(texts: DataFrame, instances: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Values accepted by confident patterns, or None without any. instances: ``value, pattern, known, first, long``; ``first`` is null for a shape."""
    # distinct links of the graph with their numbers of occurrences: hot values and patterns are pre-aggregated
    links = scratch.save(instances.groupBy("pattern", "value", "known").agg(F.count("*").alias("n"), F.max("first").alias("first"), F.max("long").alias("long")), "links")
    if links.where("not known").isEmpty():
        return None
    # shapes are seen wherever their tokens are
    total = scratch.save(links.where("first is null").groupBy("pattern").agg(F.sum("n").alias("n_seen")), "shapes")
    known, accepted, counted = links.where("known").select("value").distinct().withColumn("seed", F.lit(True)), None, None
    # the accepted set only grows, so this ends
    while True:
        support = links.join(known, "value").where("seed or first is not null").groupBy("pattern").agg(F.countDistinct("value").alias("n_values"), F.sum("n").alias("n_hits"), F.max("first").alias("first"), F.max("long").alias("long")).where(F.col("n_values") >= LEAST_VALUES)
        # only patterns that could give a new instance
        support = scratch.save(support.join(links.where("not known").select("pattern").distinct(), "pattern", "left_semi"), "support")
        fresh = support.where("first is not null")
        fresh = fresh if counted is None else fresh.join(counted, "pattern", "left_anti")
        n, most = fresh.agg(F.count("*"), F.max("long")).first()
        if n:
            seen = scratch.save(_seen(texts, "t", fresh.select("pattern", "first"), n, most, scratch), "seen")
            total = total.unionByName(seen)
            counted = seen.select("pattern") if counted is None else counted.unionByName(seen.select("pattern"))
        share = F.col("n_hits") / (F.greatest("n_seen", "n_hits") + 1)
        confident = support.join(total, "pattern").select("pattern", share.alias("confidence"), F.col("first").isNull().alias("shape"))
        confident = confident.where(F.col("confidence") >= F.when(F.col("shape"), SHAPE_CONFIDENT).otherwise(CONFIDENT))
        chance = 1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        new = links.where("not known").join(confident, "pattern").groupBy("value").agg(chance.alias("chance")).where(F.col("chance") >= ACCEPT).select("value")
        new = scratch.save(new if accepted is None else new.join(accepted, "value", "left_anti"), "new")
        if new.isEmpty():
            return accepted
        accepted = new if accepted is None else accepted.unionByName(new)
        # a value that is also a seed stays one row
        known = known.unionByName(new.withColumn("seed", F.lit(False))).groupBy("value").agg(F.max("seed").alias("seed"))
