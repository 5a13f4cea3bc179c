"""Messages delivered more than once: exactly one delivery of each message stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.session import cut

#: Bits of the sieve that tells which identifiers may be repeated: 2 MB, whatever the data.
SIEVE_BITS = 1 << 24


def canonical_id(text: Column) -> Column:
    """Hexadecimal identifier in lower case without hyphens; null for null, empty or other text."""
    plain = F.lower(F.replace(F.trim(text), F.lit("-"), F.lit("")))
    return F.when(plain.rlike("^[0-9a-f]+$"), plain)


def _sieved(known: DataFrame, repeated: DataFrame, key: list[str]) -> DataFrame:
    """The rows of `known` whose key may be among `repeated`: a bitmap of key hashes, of SIEVE_BITS bits at most, is broadcast in pieces of 4 kB. No row of
    a repeated key is lost; where the bitmap is full, singletons pass too and the join that follows leaves them out."""
    h = F.pmod(F.xxhash64(*key), F.lit(SIEVE_BITS))
    bits = repeated.select(h.alias("__h")).groupBy(F.expr("bitmap_bucket_number(__h)").alias("__b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__h))").alias("__bits"))
    d = known.withColumn("__h", h).withColumn("__b", F.expr("bitmap_bucket_number(__h)")).join(F.broadcast(bits), "__b")
    at = "bitmap_bit_position(__h)"
    return d.where(F.expr(f"(cast(conv(hex(substr(__bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast({at} % 8 as int))) <> 0")).drop("__h", "__b", "__bits")


def split_by_frequency(messages: DataFrame, key: list[str], order: list[str], stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, surplus) of `messages`, which has unique rows by `order`. `stored` holds messages kept by earlier runs, in the same columns: they
    take part in the count and come before every new one, so that a new copy of a stored message is surplus; only rows of `messages` come out.

    Identifiers are counted once with map-side combining, and the same aggregation carries the smallest `order`
    of each. An identifier counted once goes straight to the result from that aggregate: its row is never
    joined or sorted. Only rows that may be of repeated identifiers, told by a bitmap of bounded size, are looked up again; rank 1 of a group
    is the aggregate's smallest, so a group of any size is compared row by row and never gathered or sorted in one task (adaptive
    execution splits the hot side of that join).

    Rows with a null in `key` identify no message: they are always kept. Ties on the first columns of `order` are
    decided by the later ones. An empty table gives two empty tables."""
    cols = [*key, *order]
    has_key = " and ".join(f"`{k}` is not null" for k in key)
    known = messages.where(has_key).select(*cols, F.lit(True).alias("__new"))
    if stored is not None:
        known = known.unionByName(stored.where(has_key).select(*cols, F.lit(False).alias("__new")))
    rank = ["__new", *order]
    freq = known.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*rank)).alias("__first"))
    singles = freq.where("__n = 1").select(*key, "__first.*").where("__new").select(*cols)
    repeated = freq.where("__n > 1").select(*key, "__first")
    ranked = _sieved(known, repeated, key).where("__new").join(repeated, key).withColumn("__keep", F.struct(*rank) == F.col("__first"))
    kept = singles.unionByName(ranked.where("__keep").select(*cols)).unionByName(
        messages.where(" or ".join(f"`{k}` is null" for k in key)).select(*cols))
    return kept, ranked.where("not __keep").select(*cols)


def alert_messages(alerts: DataFrame, feeds: DataFrame) -> DataFrame:
    """delivery_id, received_at, source, ident, at_us of each delivery; `ident` is null where the message cannot be told.

    Null and broken payloads, unknown feeds and other shapes have no identity. A delivery of several alerts has none either: it is kept, so that none
    of its alerts is lost with it."""
    from faultline.operators.alert_times import alert_instants

    t = alert_instants(alerts, feeds)
    ident = canonical_id(F.when(F.col("shape") == "alertmanager", F.when(F.get_json_object("payload", "$.alerts[1]").isNull(), F.get_json_object("payload", "$.alerts[0].fingerprint")))
                         .when(F.col("shape") == "sentry", F.get_json_object("payload", "$.data.event.event_id")))
    return t.select("delivery_id", F.coalesce("received_at", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).alias("received_at"), F.col("shape").alias("source"),
                    F.when((F.col("shape") == "sentry") | F.col("utc_us").isNotNull(), ident).alias("ident"),
                    F.when(F.col("shape") == "sentry", F.lit(0)).otherwise(F.coalesce("utc_us", F.lit(0))).alias("at_us"))


def exactly_once(alerts: DataFrame, feeds: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, surplus) deliveries by message, the earliest received and then the smallest delivery_id kept. Both hold the columns of alert_messages(), and the
    kept ones of all earlier runs are what `stored` takes. A null received_at comes last.

    The narrow table of identities is written to the shared folder once, because it is read twice."""
    return split_by_frequency(cut(alert_messages(alerts, feeds)), ["source", "ident", "at_us"], ["received_at", "delivery_id"], stored)
