"""The counterparty index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from remitra.config import loader, values
from remitra.config.loader import Config
from remitra.functions.numbers import millions, r2
from remitra.functions.text import clean_name, named, zs_trim
from remitra.operators.fact import Dims
from remitra.operators.names import with_clean_name
from remitra.operators.scale import top_k, top_k_per_group


def entity_sides(tx: DataFrame) -> DataFrame:
    """Each transaction once per named party: side 0 sent, side 1 received; one scan."""
    party = lambda side, name, other: F.struct(
        F.lit(side).alias("side"), F.col(name).alias("nm"), F.col(other).alias("other")
    )
    both = F.array(party(0, "tr_name", "rc_name"), party(1, "rc_name", "tr_name"))
    return (
        tx.withColumn("_party", F.explode(F.filter(both, lambda p: p["nm"].isNotNull())))
        .drop("tr_name", "rc_name").select("*", "_party.*").drop("_party")
    )


def anti_blocklist(ent: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Drop placeholder names. An anti join, since one NULL in NOT IN would drop every row."""
    return ent.join(
        blocklist, F.upper(zs_trim(F.col("nm"))) == F.col("blocked"), "left_anti"
    )


def entities_filtered(tx: DataFrame, config: Config) -> DataFrame:
    ent = entity_sides(tx).filter(named(F.col("nm")))
    ent = anti_blocklist(ent, loader.blocklist_frame(tx.sparkSession, config))
    return ent.withColumn("nm", zs_trim(F.col("nm")))


def placeholder_removed(ent_raw: DataFrame, totals: DataFrame) -> DataFrame:
    """How many party rows, and what value, the name rules removed."""
    total = lambda df, n, sign: df.agg(
        (n * sign).alias("n"), (F.coalesce(F.sum("usd"), F.lit(0.0)) * sign).alias("usd")
    )
    return total(ent_raw, F.count("*"), 1).unionByName(total(totals, F.sum("n"), -1)).agg(
        F.sum("n").alias("removed"), r2(millions(F.sum("usd"))).alias("removed_usd_m")
    )


def entity_totals(ent: DataFrame) -> DataFrame:
    """Per name: rows and value, by direction and by side, and the years spanned."""
    part = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("usd")).otherwise(0.0))
    return ent.groupBy("nm").agg(
        F.count("*").alias("n"), F.sum("usd").alias("usd"),
        part("flow_ix", 1).alias("usd_in"), part("flow_ix", 0).alias("usd_out"),
        part("side", 1).alias("received"), part("side", 0).alias("sent"),
        F.min("yr").alias("y0"), F.max("yr").alias("y1"),
    )


def order_by_value() -> list[Column]:
    return [F.col("usd").desc_nulls_last(), F.col("nm")]


def entity_keep(totals: DataFrame, n: int = values.ENTITY_LIMIT) -> DataFrame:
    """The ``n`` largest entities and their rank; the window sees at most ``n`` rows."""
    kept = top_k(totals, order_by_value(), n)
    return kept.withColumn("ix", (F.row_number().over(W.orderBy(*order_by_value())) - 1))


def keep_entities(ent: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of the kept entities; ``keep`` is capped, so its size is known."""
    return ent.join(F.broadcast(keep.select("nm", "ix")), "nm")


def entity_by_year(kept: DataFrame) -> DataFrame:
    return kept.groupBy("ix", "yr", "flow_ix").agg(
        F.count("*").alias("n"), r2(millions(F.sum("usd"))).alias("usd_m")
    )


def entity_tops(kept: DataFrame, dims: Dims, n: int = values.ENTITY_TOP) -> DataFrame:
    """The ``n`` main countries, purposes, banks and currencies of each entity.

    One scan serves all four: each row contributes to four sums, which are
    combined before the shuffle. Spellings of one bank are added up first.
    """
    fields = {"bank": "bank", "ctry": "country", "curr": "currency", "pur": "pur5"}
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("val"))
        for kind, column in fields.items()
    ])
    sums = (
        kept.select("ix", "usd", F.inline(F.filter(pairs, lambda p: p["val"].isNotNull())))
        .groupBy("ix", "kind", "val").agg(F.sum("usd").alias("usd"))
    )
    label = dims.banks.select(
        F.lit("bank").alias("kind"), F.col("bank").alias("val"), F.col("label").alias("_label")
    )
    sums = (
        sums.join(label, ["kind", "val"], "left")
        .groupBy("ix", "kind", F.coalesce("_label", "val").alias("val"))
        .agg(F.sum("usd").alias("usd"))
    )
    order = [F.col("usd").desc_nulls_last(), F.col("val")]
    ranked = top_k_per_group(sums, ["ix", "kind"], order, n)
    known = _positions("bank", dims.banks.filter("bank = label"), "bank", "bank_ix")
    known = known.unionByName(_positions("ctry", dims.countries, "country", "country_ix"))
    known = known.unionByName(_positions("curr", dims.currencies, "currency", "currency_ix"))
    known = known.unionByName(_positions("pur", dims.purposes, "code", "purpose_ix"))
    return ranked.join(known, ["kind", "val"]).select(
        "ix", "kind", "rn", "val", "val_ix", r2(millions(F.col("usd"))).alias("usd_m")
    )


def _positions(kind: str, dim: DataFrame, key: str, ix: str) -> DataFrame:
    return dim.select(
        F.lit(kind).alias("kind"), F.col(key).alias("val"), F.col(ix).alias("val_ix")
    )


def entity_tx(kept: DataFrame, dims: Dims, n: int = values.ENTITY_TX_LIMIT) -> DataFrame:
    """The ``n`` largest transactions of each kept entity.

    ``n`` is small, so an entity's rows aren't cut in slices: each would keep
    its own ``n``, which for most entities is all there are.
    """
    order = [F.col("usd").desc_nulls_last(), F.col("Hash_ID").asc_nulls_last(), F.col("side")]
    ranked = top_k_per_group(
        kept.select("ix", "side", "Hash_ID", "ymd", "flow_ix", "bank", "currency", "amt_orig",
                    "usd", "country", "pur5", "other"),
        ["ix"], order, n,
    )
    lookups = [
        ("bank", dims.banks.select("bank", "bank_ix"), "bank_ix"),
        ("currency", dims.currencies.select("currency", "currency_ix"), "currency_ix"),
        ("country", dims.countries.select("country", "country_ix"), "country_ix"),
        ("pur5", dims.purposes.select(F.col("code").alias("pur5"), "purpose_ix"), "purpose_ix"),
    ]
    for key, dim, ix in lookups:
        ranked = ranked.join(dim, key, "left").withColumn(ix, F.coalesce(ix, F.lit(-1)))
    return ranked.select(
        "ix", "rn", "side", "Hash_ID", "ymd", "flow_ix", "bank_ix", "currency_ix",
        r2(F.col("amt_orig"), 2).alias("amt"), r2(F.col("usd"), 2).alias("usd"),
        "country_ix", "purpose_ix", "other",
    )


@dataclass
class EntityParts:
    keep: DataFrame
    by_year: DataFrame
    tops: DataFrame
    tx: DataFrame


def entity_documents(parts: EntityParts) -> DataFrame:
    """One nested row per kept entity. Every list has a declared length limit or one row a year."""
    def listed(df: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
        item = F.struct(*[F.col(c) for c in [*order, *fields]])
        rows = df.groupBy("ix").agg(F.array_sort(F.collect_list(item)).alias(name))
        return rows.withColumn(
            name, F.transform(name, lambda i: F.struct(*[i[f].alias(f) for f in [*order, *fields]]))
        )

    docs = parts.keep.select(
        "ix", F.coalesce(clean_name(F.col("nm")), "nm").alias("nm"), "n",
        r2(millions(F.col("usd"))).alias("usd"), r2(millions(F.col("usd_in"))).alias("in"),
        r2(millions(F.col("usd_out"))).alias("out"), "y0", "y1",
    )
    lists = [listed(parts.by_year, ["yr", "flow_ix"], ["n", "usd_m"], "years")]
    for kind in ("ctry", "pur", "bank", "curr"):
        lists.append(
            listed(parts.tops.filter(F.col("kind") == kind), ["rn"], ["val_ix", "usd_m"], kind)
        )
    tx = with_clean_name(parts.tx, "other", "other_name").withColumn("other", F.col("other_name"))
    lists.append(listed(
        tx, ["rn"],
        ["ymd", "flow_ix", "bank_ix", "currency_ix", "amt", "usd", "country_ix", "purpose_ix", "other"],
        "tx",
    ))
    for part in lists:
        name = part.columns[1]
        docs = docs.join(part, "ix", "left").withColumn(name, F.coalesce(name, F.array()))
    return docs


def entity_coverage(totals: DataFrame, keep: DataFrame) -> DataFrame:
    """How much of all named value the kept entities hold, in percent."""
    every = totals.agg(F.count("*").alias("total"), millions(F.sum("usd")).alias("all_usd"))
    kept = keep.agg(
        F.count("*").alias("kept"), F.sum(r2(millions(F.col("usd")))).alias("kept_usd")
    )
    both = every.unionByName(kept, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("total", "all_usd", "kept", "kept_usd")]
    )
    return both.select(
        "total", "kept",
        r2(F.try_divide(F.lit(100) * F.col("kept_usd"), F.col("all_usd")), 1).alias("cover_pct"),
    )


def all_names(totals: DataFrame) -> DataFrame:
    """Every counterparty with its count and what it received and sent."""
    return totals.select(
        "nm", "n", r2(millions(F.col("received"))).alias("received"),
        r2(millions(F.col("sent"))).alias("sent"),
    )


def sort_ci(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.lower(column), column)
