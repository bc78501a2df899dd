"""Secret scanning with multipart credential linking.

Candidates are found by pattern, with their place, inside the row. Strong ones (an assignment to a
secret's name, a long access key id, a long hexadecimal run) are reported by themselves. Weak ones (an
identifier, a bare random-looking string, an endpoint) are reported only if complementary parts lie
within SCOPE characters: the parts of a text are interval-joined by sweeping them in order of place, so
each part meets the nearest part of each other role and no pairs are made. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Fixed patterns of the strong kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Least length of what each kind must hold: the assigned value, the key id, the run.
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Weak parts: short or assigned identifiers, random-looking strings of a key's length, and endpoints.
WEAK_ID = r"""(?i:access_?key_?id|client_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}|AKIA[A-Z0-9]{4,}"""
WEAK_SECRET = r"[A-Za-z0-9+/=_-]{20,}"
WEAK_SECRET_FORM, WEAK_SECRET_PARTS = r"^[A-Za-z0-9+/]{20,}={0,2}$", ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"""(?i:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?"""
#: Code points within which parts complement each other.
SCOPE = 200

KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
_ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}


def _places(text: Column, pattern: str, kind: str, keep) -> Column:
    """Leftmost non-overlapping matches as array<struct<order, kind, start, end>>, without those that fail keep(match).

    The text between matches and the matches alternate, so places are running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("m"), F.transform(F.slice(between, 1, F.size(found)), lambda b: F.length(b)).alias("b"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    run = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["b"] + x["m"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["b"]).alias("start"), (acc["at"] + x["b"] + x["m"]).alias("end"))).alias("out")),
    )["out"]
    spans = F.filter(F.arrays_zip(found.alias("m"), run.alias("s")), lambda x: keep(x["m"]))
    named = F.transform(spans, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end")))
    return F.when(text.rlike(pattern), named).otherwise(F.array().cast("array<struct<order:int,kind:string,start:int,end:int>>"))


def _parts(text: Column) -> Column:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST

    def random_looking(m: Column) -> Column:
        fits = m.rlike(WEAK_SECRET_FORM)
        for part in WEAK_SECRET_PARTS:
            fits = fits & m.rlike(part)
        return fits

    return F.concat(
        _places(text, ASSIGN, "assign", value),
        # A shorter run is never part of a longer one, so the least length can stand in the pattern.
        _places(text, ACCESS.replace("+", f"{{{ACCESS_LEAST - 4},}}"), "access", lambda m: F.lit(True)),
        _places(text, HEX.replace("+", f"{{{HEX_LEAST},}}"), "hex", lambda m: F.lit(True)),
        # A key id of ACCESS_LEAST characters is a strong one.
        _places(text, WEAK_ID, "weak_id", lambda m: ~(m.startswith("AKIA") & (F.length(m) >= ACCESS_LEAST))),
        _places(text, WEAK_SECRET, "weak_secret", random_looking),
        _places(text, ENDPOINT, "endpoint", lambda m: F.lit(True)),
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id and secrets, array<struct<start, order, kind, end>> by start and kind, without texts.

    Starts and ends count code points, the end exclusive. A null or empty text has no secrets. Repeated
    rows each get their own result; a null id stays null; other columns are ignored. An identifier is
    complemented by a secret, a secret by an identifier or an endpoint, an endpoint by a secret together
    with an identifier.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _parts(text_of(text_col)).alias("parts"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("doc_id", "row", F.explode_outer("parts").alias("p")).select("doc_id", "row", "p.*")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in _ROLE.items() for x in kv]), F.coalesce("kind", F.lit("hex")))
    parts = parts.withColumn("role", role)
    swept = Window.partitionBy("doc_id", "row").orderBy("start", "order")
    before, after = swept.rowsBetween(Window.unboundedPreceding, Window.currentRow), swept.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def near(wanted: str) -> Column:
        mine = F.col("role") == wanted
        gap_before = F.col("start") - F.max(F.when(mine, F.col("end"))).over(before)
        gap_after = F.min(F.when(mine, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(gap_before <= scope, F.lit(False)) | F.coalesce(gap_after <= scope, F.lit(False))

    joined = parts.select("*", near("id").alias("by_id"), near("secret").alias("by_secret"), near("endpoint").alias("by_endpoint"))
    linked = F.expr("order < 3 or (kind = 'weak_id' and by_secret) or (kind = 'weak_secret' and (by_id or by_endpoint)) or (kind = 'endpoint' and by_id and by_secret)")
    span = F.when(linked, F.struct("start", "order", "kind", "end"))
    return joined.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(span)).alias("secrets")).select("doc_id", "secrets")


def secret_spans(found: Column, strong_only: bool) -> Column:
    """kind:start:end of each secret in order, comma-joined."""
    chosen = F.filter(found, lambda s: s["order"] < 3) if strong_only else found
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
