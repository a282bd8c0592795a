"""Feature documents: packing, typed unpacking, clipping and null profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.scalars import clip, finite, to_int

C = F.col
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
SCHEMA_FREE = "map<string,double>"


def _document_key(column: str) -> str:
    """Raw macro columns carry a suffix only to stay apart from their
    lower-case twins; the document uses the plain series key."""
    return column.removesuffix("_raw")


def pack_features(df: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """One JSON document per row from every column that is not a bar column.

    NaN, infinities and non-numeric values become null; keys are kept.
    """
    skip = set(cfg.BAR_COLUMNS) | set(keys)
    fields = []
    for name, kind in df.dtypes:
        if name in skip:
            continue
        value = (finite(C(f"`{name}`").cast("double")) if kind in NUMERIC
                 else F.lit(None).cast("double"))
        fields.append(value.alias(_document_key(name)))
    doc = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(*keys, doc.alias("feature_json"))


def unpack_features(df: DataFrame, features: list[str],
                    source_keys: dict[str, str] | None = None,
                    integers=tuple(cfg.INTEGER_FEATURES)) -> DataFrame:
    """Replace ``feature_json`` by typed columns, parsing each document once.

    The declared keys form the parse schema, so unselected features are never
    materialised.
    """
    source_keys = cfg.SOURCE_KEYS if source_keys is None else source_keys
    schema = ", ".join(f"`{source_keys.get(f, f)}` double" for f in features)
    parsed = df.withColumn("_doc", F.from_json("feature_json", schema))
    rest = [c for c in df.columns if c != "feature_json"]
    cols = []
    for f in features:
        value = C("_doc").getField(source_keys.get(f, f))
        cols.append((to_int(value) if f in integers else value).alias(f))
    return parsed.select(*rest, *cols)


def as_map(doc: Column | str = "feature_json") -> Column:
    return F.from_json(doc, SCHEMA_FREE)


def infer_keys(df: DataFrame) -> list[str]:
    """Union of document keys; an explicit extra pass over the documents."""
    rows = (df.select(F.explode(F.json_object_keys("feature_json")).alias("k"))
            .distinct().orderBy("k").collect())
    return [r.k for r in rows]


def clip_documents(df: DataFrame, rules: dict[str, tuple[float, float]] | None = None,
                   column: str = "features") -> DataFrame:
    """Clip the values of a map column by a rule per feature.

    Rules go by dataset columns; documents use source keys where both differ.
    Missing rules and null / non-finite values leave an entry as it is.
    """
    rules = cfg.default_clip_rules() if rules is None else rules
    rules = {cfg.SOURCE_KEYS.get(k, k): v for k, v in rules.items()}
    low = F.create_map(*[x for k, (lo, _) in rules.items()
                         for x in (F.lit(k), F.lit(float(lo)))])
    high = F.create_map(*[x for k, (_, hi) in rules.items()
                          for x in (F.lit(k), F.lit(float(hi)))])

    def bounded(key, value):
        usable = finite(value).isNotNull() & F.array_contains(
            F.array(*[F.lit(k) for k in rules]), key)
        return F.when(usable, F.greatest(
            F.try_element_at(low, key),
            F.least(F.try_element_at(high, key), value))).otherwise(value)

    return df.withColumn(column, F.transform_values(column, bounded))


def null_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, nan_count, total_rows, nan_pct) for chosen document keys."""
    doc = as_map()
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 F.try_element_at(doc, F.lit(f)).isNull().cast("long").alias("gone"))
        for f in features])
    return (df.select(F.inline(entries)).groupBy("feature")
            .agg(F.sum("gone").alias("nan_count"),
                 F.count("*").alias("total_rows"))
            .withColumn("nan_pct", F.round(
                100.0 * C("nan_count") / C("total_rows"), 2)))


__all__ = ["pack_features", "unpack_features", "as_map", "infer_keys",
           "clip_documents", "null_profile", "clip"]
