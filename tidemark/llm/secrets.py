"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are found by patterns.  A fourth kind, ``owned``, is added: bare
tokens of letters and digits that no base span covers.  Every candidate's hash is
counted over distinct repositories and owners of the whole corpus: values that many
owners hold are widely copied examples; those of few owners look live.  Base spans
stay whatever their verdict; bare tokens become spans only if they look live.

Positions come from splitting the text at the pattern: matches and the pieces
between them alternate, so running sums of their lengths give the starts.  Running
values are folded in blocks of about the root of a text's matches, so that a text of n
matches takes about n * sqrt(n) cheap steps and no string is copied more than twice.

Defined results: a null text is an empty one and has no spans; rows are scanned
each for itself, and repeated rows of an owner count once for it; null owners and
repositories count as one of their own; an empty table gives an empty result; further
columns, whatever their names, stay as they are in ``redact`` and are ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import column, materialise

# The base kinds in their order, each with its pattern, the group that holds the value and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Bare tokens: 24 or more characters with a digit among them (letters without one are ordinary long words).
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}"
#: A value held by at most so many owners looks live.
MOST_OWNERS = 2
#: Parts that the occurrences of one value are dealt into when they meet its verdict.
PARTS = 1024

_FAR = 1 << 62


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body with a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array cut into about as many runs as a run has items; an empty one is one empty run."""

    def cut(items: Column, run: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(items) / run).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * run + 1, run))

    return _let(items, lambda items: _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int"), lambda run: cut(items, run)))


def _before(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column], initial: int) -> Column:
    """For each item the merged values of all items before it."""
    start = F.struct(F.lit(initial).cast("long").alias("at"), F.array().cast("array<bigint>").alias("seen"))

    def fold(values: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(values, start, lambda done, x: F.struct(merge(done["at"], of(x)).alias("at"), F.concat(done["seen"], F.array(done["at"])).alias("seen")))

    def joined(folded: Column) -> Column:
        return F.flatten(F.zip_with(folded, fold(folded, lambda b: b["at"])["seen"], lambda b, upto: F.transform(b["seen"], lambda seen: merge(upto, seen))))

    return _let(F.transform(_blocks(items), lambda block: fold(block, value)), joined)


def _matches(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """An array of spans: the pattern's matches whose value is long enough."""
    whole, values, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    found = F.zip_with(F.zip_with(whole, F.slice(pieces, 1, F.size(whole)), lambda m, p: F.struct(m.alias("m"), p.alias("p"))), values, lambda x, v: F.struct(F.length(x["p"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("own"), v.alias("value")))

    def spans(found: Column) -> Column:
        upto = _before(found, lambda x: x["gap"] + x["own"], lambda a, b: a + b, 0)
        span = lambda x, at: F.struct((at + x["gap"]).alias("at"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + x["gap"] + x["own"]).alias("until"), x["value"].alias("value"))
        return F.filter(F.zip_with(found, upto, span), lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(F.array().cast("array<struct<at:bigint,rank:int,kind:string,until:bigint,value:string>>"))


def _clear(bare: Column, base: Column) -> Column:
    """The bare spans that no base span overlaps: none before ends later than they start, none after starts before their end."""
    is_base = lambda s: s["rank"] < len(KINDS)

    def kept(spans: Column) -> Column:
        ends = _before(spans, lambda s: F.when(is_base(s), s["until"]).otherwise(F.lit(0)), lambda a, b: F.greatest(a, b), 0)
        starts = F.reverse(_before(F.reverse(spans), lambda s: F.when(is_base(s), s["at"]).otherwise(F.lit(_FAR)), lambda a, b: F.least(a, b), _FAR))
        met = F.zip_with(F.zip_with(spans, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), starts, lambda x, a: F.struct(x["s"].alias("s"), (is_base(x["s"]) | (x["e"] > x["s"]["at"]) | (a < x["s"]["until"])).alias("met")))
        return F.transform(F.filter(met, lambda x: ~x["met"]), lambda x: x["s"])

    return F.when((F.size(bare) > 0) & (F.size(base) > 0), _let(F.sort_array(F.concat(bare, base)), kept)).otherwise(bare)


def find_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add arrays of spans: ``base_spans`` of the base kinds, ``bare_spans`` of bare tokens clear of them."""
    text = F.coalesce(column(text_col), F.lit(""))
    base = F.sort_array(F.concat(*[_matches(text, kind, rank, pattern, group, least) for rank, (kind, pattern, group, least) in enumerate(KINDS)]))
    found = F.struct(base.alias("base"), _matches(text, "owned", len(KINDS), BARE, 0, 24).alias("bare"))
    both = _let(found, lambda x: F.struct(x["base"].alias("base"), _clear(x["bare"], x["base"]).alias("bare")))
    return docs.withColumn("base_spans", both).withColumns({"base_spans": F.col("base_spans.base"), "bare_spans": F.col("base_spans.bare")})


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", most_owners: int = MOST_OWNERS) -> DataFrame:
    """Rows (id, base_spans, spans): spans adds those of live-looking bare tokens; each has a verdict, n_repos and n_owners.

    Spans are arrays of struct(at, rank, kind, until, value), in code points, until exclusive.
    """
    docs = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"), column(repo_col).cast("string").alias("_repo"), column(owner_col).cast("string").alias("_owner"))
    found = find_candidates(docs.withColumn("_row", F.xxhash64("_text")), "_text")
    found = materialise(found.select("_id", "_row", "_repo", "_owner", "base_spans", "bare_spans"))
    each = found.select("_id", "_row", F.coalesce("_repo", F.lit("\0")).alias("repo"), F.coalesce("_owner", F.lit("\0")).alias("owner"), F.explode(F.concat("base_spans", "bare_spans")).alias("span")).withColumn("hash", F.sha2("span.value", 256))
    # Distinct holders first: a value that a third of all rows hold is a row for each holder when it meets its like.
    held = each.select("hash", "repo", "owner").distinct().groupBy("hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
    verdict = F.when(F.col("n_owners") <= most_owners, "live").otherwise("example")
    # The occurrences of a value meet its verdict in parts, each of which gets a copy of it.
    each = each.withColumn("part", F.pmod(F.xxhash64("_id", "_row"), F.lit(PARTS)))
    judged = each.join(each.select("hash", "part").distinct().join(held, "hash"), ["hash", "part"]).where((F.col("span.rank") < len(KINDS)) | (verdict == "live"))
    judged = judged.groupBy("_id", "_row").agg(F.sort_array(F.collect_set(F.struct("span.*", verdict.alias("verdict"), "n_repos", "n_owners"))).alias("spans"))
    out = found.select("_id", "_row", "base_spans").alias("f").join(judged.alias("j"), F.col("f._id").eqNullSafe(F.col("j._id")) & (F.col("f._row") == F.col("j._row")), "left")
    empty = F.array().cast(judged.schema["spans"].dataType)
    return out.select(F.col("f._id").alias(id_col), F.col("f._row").alias("text_hash"), "base_spans", F.coalesce("spans", empty).alias("spans"))


def span_list(spans: str) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"], s["until"])), ",")


def masked(text: Column, spans: Column, marker: str) -> Column:
    """A text with one marker in place of each run of overlapping span values."""
    values = F.sort_array(F.transform(spans, lambda s: F.struct((s["until"] - F.length(s["value"])).alias("at"), s["until"].alias("until"))))
    cut = lambda whole, at, size: F.substring(whole, (at + 1).cast("int"), size.cast("int"))
    most = lambda a, b: F.greatest(a, b)

    def piece(block_text: Column, start: Column, v: Column) -> Column:
        return F.when(v["at"] >= v["upto"], F.concat(cut(block_text, v["upto"] - start, v["at"] - v["upto"]), F.lit(marker))).otherwise(F.lit(""))

    def joined(values: Column) -> Column:
        each = F.zip_with(values, _before(values, lambda v: v["until"], most, 0), lambda v, upto: F.struct(v["at"].alias("at"), v["until"].alias("until"), upto.alias("upto")))
        # A block of values has its own piece of the text, from the end of what comes before it to its last end.
        blocks = F.transform(F.filter(_blocks(each), lambda b: F.size(b) > 0), lambda b: F.struct(b.alias("values"), b[0]["upto"].alias("start"), F.greatest(b[0]["upto"], F.array_max(F.transform(b, lambda v: v["until"]))).alias("stop")))
        lines = F.transform(blocks, lambda b: _let(cut(text, b["start"], b["stop"] - b["start"]), lambda own: F.array_join(F.transform(b["values"], lambda v: piece(own, b["start"], v)), "")))
        last = F.coalesce(F.array_max(F.transform(values, lambda v: v["until"])), F.lit(0))
        return F.concat(F.array_join(lines, ""), cut(text, last, F.length(text)))

    return _let(values, joined)


def redact(docs: DataFrame, marker: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", **scan: object) -> DataFrame:
    """The rows with the value of each span replaced by a marker; null texts stay null."""
    scanned = scan_secrets(docs, id_col=id_col, text_col=text_col, **scan).where(F.size("spans") > 0)
    scanned = scanned.select(column(id_col).alias("id"), F.col("text_hash").alias("row"), "spans").distinct()
    # The rows' own columns travel in one struct, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*map(column, docs.columns)).alias("own")).withColumn("at", F.xxhash64(column("own", text_col)))
    joined = own.join(scanned, column("own", id_col).eqNullSafe(F.col("id")) & (F.col("at") == F.col("row")), "left")
    text = column("own", text_col)
    return joined.select(*[(F.when(F.col("spans").isNotNull(), masked(text, F.col("spans"), marker)).otherwise(text) if c == text_col else column("own", c)).alias(c) for c in docs.columns])
