"""Secret scans in DataFrame operations: base patterns, and linking of multipart credentials.

Each pattern is applied to the whole text; `split` and `regexp_extract_all` see the same leftmost
non-overlapping matches, so the lengths of gaps and matches give their positions. Weak candidates
are kept only where complementary parts lie in one section of the text, or within reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base patterns, in the order in which spans of one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Own choice: weak candidates. An identifier, a long mixed run, an address.
WEAK_ID = r"""(?i:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
WEAK_SECRET = r"[A-Za-z0-9+/=_-]{24,}"
ENDPOINT = r"""(?i:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb|s3)://[^\x20\x09-\x0D"'<>]+"""

#: Name, pattern whose maximal matches are taken, least length of the checked group, that group.
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("link_id", WEAK_ID, 1, 3),
    ("link_secret", WEAK_SECRET, 0, 24),
    ("link_endpoint", ENDPOINT, 0, 8),
)
N_BASE = 3
#: Number of the breaks between sections, which are placed as matches are.
BREAK = len(KINDS)


def _break(reach: int) -> tuple:
    """What ends a section, as a kind: a blank line, or white space of `reach` characters."""
    return "break", r"\n[\x20\t\r]*\n\s*|\s{%d,}" % max(reach, 1), 0, 1


def _matches(text: str, number: int, kind: tuple) -> Column:
    """Matches of one kind: array of (kind, i, gap before, length, holds)."""
    name, pattern, group, least = kind
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    checked = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    mixed = F.lit(name != "link_secret")

    def one(x: Column, i: Column) -> Column:
        value = x["checked"]
        holds = (F.length(value) >= least) & (mixed | (value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")))
        return F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("size"), holds.alias("holds"))

    zipped = F.arrays_zip(hits.alias("hit"), checked.alias("checked"), F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(0))).alias("gap"))
    # Texts without a match, nearly all, are scanned once.
    return F.when(F.col(text).rlike(pattern), F.transform(zipped, one))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """One row per span: row_key (key, text hash), kind, place, start, end, credential; code points, end exclusive.

    Base kinds: assign, access, hex. Linked kinds: link_id, link_secret, link_endpoint. An identifier
    (access or link_id) and a secret (assign, hex or link_secret) are complementary; link_id and
    link_secret are kept only with a complementary part in their section or within `reach` characters,
    link_endpoint only with both. A section, however long, ends at a blank line or at white space of
    `reach` characters or more. Candidates inside an assign, access or hex span are that span, not a part.
    Rows alike in key and text give their spans once.

    credential numbers, from 1 in each text, what belongs together: spans follow each other into one
    credential as long as they are in one section or at most `reach` characters apart. It is null
    where there is no identifier or no secret among them.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Sections matter only where there are weak candidates.
    weak = F.col("text").rlike("|".join(f"(?:{p})" for p in (WEAK_ID, WEAK_SECRET, ENDPOINT)))
    matches = [*(_matches("text", k, kind) for k, kind in enumerate(KINDS)), F.when(weak, _matches("text", BREAK, _break(reach)))]
    found = own.select("key", F.xxhash64("text").alias("hash"), F.flatten(F.array_compact(F.array(*matches))).alias("found"))
    # Rows of equal key and text become one: matches are told apart by kind and number.
    rows = found.select("key", "hash", F.explode("found").alias("m")).select("key", "hash", "m.*").distinct()
    running = Window.partitionBy("key", "hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(running)).where("holds").select("key", "hash", "kind", (F.col("end") - F.col("size")).alias("start"), "end")

    kind = F.col("kind")
    base = kind < N_BASE
    ahead = Window.partitionBy("key", "hash").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("key", "hash").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # A candidate that a base span covers is dropped before linking.
    covered = placed.withColumn("cover", F.max(F.when(base, F.col("end"))).over(ahead)).where(base | F.coalesce(F.col("cover") < F.col("end"), F.lit(True)))
    sections = covered.withColumn("section", F.count_if(kind == BREAK).over(ahead)).where(kind != BREAK)
    within = Window.partitionBy("key", "hash", "section")
    an_id, a_secret = kind.isin(1, 3), kind.isin(0, 2, 4)

    def near(part: Column) -> Column:
        left = F.max(F.when(part, F.col("end"))).over(ahead) >= F.col("start") - reach
        right = F.min(F.when(part, F.col("start"))).over(behind) <= F.col("end") + reach
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)) | (F.count_if(part).over(within) > 0)

    linked = sections.withColumns({"by_id": near(an_id), "by_secret": near(a_secret)})
    kept = linked.where(base | ((kind == 3) & F.col("by_secret")) | ((kind == 4) & F.col("by_id")) | ((kind == 5) & F.col("by_id") & F.col("by_secret")))
    # The interval join's groups: a span begins a new one where it reaches none before it.
    in_order = Window.partitionBy("key", "hash").orderBy("start", "kind", "end")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.lag("section").over(in_order) != F.col("section")) & (F.max("end").over(before) < F.col("start") - reach)
    grouped = kept.withColumn("apart", F.coalesce(apart, F.lit(False))).withColumn("run", F.count_if("apart").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy("key", "hash", "run")
    whole = (F.count_if(an_id).over(run) > 0) & (F.count_if(a_secret).over(run) > 0)
    first = F.row_number().over(run.orderBy("start", "kind", "end")) == 1
    marked = grouped.withColumns({"whole": whole, "first": first})
    number = F.count_if(F.col("whole") & F.col("first")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), kind + 1)
    return marked.select(F.struct("key", "hash").alias("row_key"), name.alias("kind"), kind.alias("place"), "start", "end", F.when(F.col("whole"), number).alias("credential"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """One row per row of `docs`: key, n_assign, n_access, n_hex, base_sha256, spans, n_linked, credentials.

    spans: kind:start:end of all spans by start, then kind, comma-joined; base_sha256: of the same
    string of base spans only; credentials: number:kind:start:end of the spans that are part of one,
    likewise. A null text counts as empty: no spans, the digest of the empty string.
    Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    spans = secret_spans(docs, key, text, reach)
    item = F.struct("start", "place", F.concat_ws(":", "kind", "start", "end").alias("say"), "credential")
    count = lambda name: F.count_if(F.col("kind") == name)
    said = spans.groupBy("row_key").agg(count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.count_if(F.col("place") >= N_BASE).alias("n_linked"), F.array_sort(F.collect_list(item)).alias("all"))
    say = lambda items: F.concat_ws(",", F.transform(items, lambda x: x["say"]))
    said = said.select("row_key", "n_assign", "n_access", "n_hex", "n_linked", say(F.filter("all", lambda x: x["place"] < N_BASE)).alias("base"), say("all").alias("spans"), F.concat_ws(",", F.transform(F.filter("all", lambda x: x["credential"].isNotNull()), lambda x: F.concat_ws(":", x["credential"], x["say"]))).alias("credentials"))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    joined = rows.join(said, rows["key"].eqNullSafe(said["row_key.key"]) & (rows["hash"] == said["row_key.hash"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(F.col("key").alias(key), zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"), F.coalesce("credentials", F.lit("")).alias("credentials"))
