"""Secret scans: credential patterns, and whose credentials they are (native expressions only).

Candidate values are hashed and counted over the whole corpus by distinct repository and
distinct owner.  A value that many owners have is an example out of some manual; one that a
single owner has, and that looks alive, is a credential of that owner and is marked so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.session import cut_lineage

#: The patterns of the base kinds, in their order; fixed values.  Runs are greedy, so for the
#: last two a least length inside the pattern finds what dropping short matches leaves.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: any other long run of key characters that mixes cases and digits
OTHER = r"[A-Za-z0-9+/_-]{20,}={0,2}"

KINDS = ("assign", "access", "hex", "live")
LIVE = KINDS.index("live")

#: values of at least so many owners are examples
EXAMPLE_OWNERS = 3
#: a value of one owner in a third of all rows is spread over so many join keys
SALTS = 16
#: lengths of one step of a running sum; a text's matches are summed in steps of steps
STEP = 256


def running_sum(lengths: Column) -> Column:
    """Running sums of an array of numbers: the sums of blocks of ``STEP`` first, then those
    inside each block, so that no long array is copied once per entry."""
    empty = F.array().cast("array<bigint>")

    def sums(values: Column, start: Column) -> Column:
        none = F.struct(start.cast("bigint").alias("sum"), empty.alias("all"))

        def add(so_far: Column, x: Column) -> Column:
            total = so_far["sum"] + x.cast("bigint")
            return F.struct(total.alias("sum"),
                            F.concat(so_far["all"], F.array(total)).alias("all"))
        return F.aggregate(values, none, add, lambda x: x["all"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")),
                         lambda k: F.slice(lengths, k * STEP + 1, F.lit(STEP)))
    totals = F.transform(blocks, lambda b: F.aggregate(
        b, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint")))
    before = F.concat(F.array(F.lit(0).cast("bigint")), sums(totals, F.lit(0)))
    return F.when(F.size(lengths) == 0, empty).otherwise(
        F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), sums)))


def _ends(text: str, pattern: str, found: str) -> Column:
    """Where each match ends, in code points: what lies between matches and the matches."""
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.col(found),
                         lambda g, m: F.length(g) + F.length(m))
    return F.when(F.size(found) > 0, running_sum(lengths)).otherwise(
        F.array().cast("array<bigint>"))


def _looks_alive(value: Column) -> Column:
    """A letter, a digit, and at least six different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (
        F.size(F.array_distinct(F.split(value, ""))) >= 6)


def scan(docs: DataFrame, repo: Column, owner: Column, carry: Sequence[str],
         text: str = "text") -> DataFrame:
    """``row`` (the ``carry`` columns), ``repo``, ``owner``, ``base`` (spans by start and
    kind) and ``values`` (start, end, digest of what may be a live credential)."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row"),
                       repo.alias("repo"), owner.alias("owner"),
                       F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "other": OTHER}
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k)
                              for k, p in patterns.items()])
    rows = rows.select("row", "repo", "owner", *[
        F.zip_with(F.col(k), _ends("text", p, k), lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"))).alias(k)
        for k, p in patterns.items()])

    def value(x: Column) -> Column:
        return F.regexp_extract(x["match"], ASSIGN, 2)
    rows = rows.withColumn("assign", F.filter(
        F.transform("assign", lambda x: F.struct(x["start"], x["end"], value(x).alias("match"))),
        lambda x: F.length(x["match"]) >= ASSIGN_LEAST))

    def spans(kind: int) -> Column:
        return F.transform(KINDS[kind], lambda x: F.struct(x["start"], F.lit(kind).alias("kind"),
                                                           x["end"]))
    base = F.array_sort(F.concat(*map(spans, range(LIVE))))
    mixed = F.filter("other", lambda x: x["match"].rlike("[a-z]") & x["match"].rlike("[A-Z]"))
    candidates = F.filter(F.concat("assign", "access", "hex", mixed),
                          lambda x: _looks_alive(x["match"]))
    values = F.array_distinct(F.transform(candidates, lambda x: F.struct(
        (x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end"),
        F.sha2(x["match"], 256).alias("digest"))))
    return rows.select("row", "repo", "owner", base.alias("base"), values.alias("values"))


def ownership(values: DataFrame) -> DataFrame:
    """``digest``, ``n_owners``, ``n_repos`` of rows (digest, owner, repo); a null owner or
    repository is one of its own.  A widely copied value is one row per task and repository
    before it is shuffled."""
    repos = values.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("digest").agg(F.count("*").alias("n_owners"),
                                        F.sum("repos").alias("n_repos"))


def find_secrets(docs: DataFrame, repo: Column, owner: Column, text: str = "text",
                 carry: Sequence[str] | None = None,
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``row`` (the ``carry`` columns, or all), ``base`` and ``spans`` (arrays of start, kind, end in code points,
    by start and kind), ``n_live``, ``n_example``: one row per row of ``docs``.

    ``spans`` are the base spans and, of kind ``live``, the values that look alive and that
    one owner alone has; ``n_example`` counts the row's values that ``example_owners`` or more
    have.  Null and empty texts have no spans; repeated rows, null ids and rows of any number
    of matches each keep their own.  Names of extra columns cannot clash.  Texts are read
    once; the spans are a table in the shared folder.
    """
    found = cut_lineage(scan(docs, repo, owner, docs.columns if carry is None else carry, text)
                        .withColumn("n", F.monotonically_increasing_id()))
    some = found.where(F.size("values") > 0)
    values = some.select("n", "repo", "owner", F.inline("values"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    verdicts = ownership(values).where(
        (F.col("n_owners") == 1) | (F.col("n_owners") >= example_owners)).select(
        F.col("digest"), (F.col("n_owners") == 1).alias("live"), every_salt.alias("salt"))
    judged = values.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int")) \
        .join(verdicts, ["digest", "salt"])
    span = F.struct("start", F.lit(LIVE).alias("kind"), "end")
    per_row = judged.groupBy("n").agg(
        F.collect_list(F.when(F.col("live"), span)).alias("live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"))
    marked = some.join(per_row, "n", "left").select(
        "row", "base",
        F.when(F.size("live") > 0, F.array_sort(F.concat("base", "live"))).otherwise(F.col("base"))
        .alias("spans"),
        F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))
    none = F.lit(0).cast("long")
    return marked.union(found.where(F.size("values") == 0).select(
        "row", "base", "base", none, none))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
