"""Learned formats: samples merged into known formats by tax id, name or layout, others registered as new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.operators.joins import best_overlap
from quillflow.operators.window import global_row_number

#: Fixed value: label sets that overlap by this much are one layout.
SAME_LAYOUT = 0.9
COLUMNS = ("name", "tax_id", "seller", "fields", "sources")


def seller_key(name: Column) -> Column:
    """A seller's name as a key: lower case, letters and digits only, null for none."""
    return F.nullif(F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""), F.lit(""))


def learn(formats: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(formats, answers) after a batch of samples.

    Formats have name (`format` and a number), tax_id, seller, fields and sources (arrays); samples have source,
    tax_id, seller and fields. Samples with a tax id go to the first format of that id, or one new format for each id;
    then those with a seller's name alone to the first format of that name, new ones of the batch included, or one new
    format for each name; then those with neither to the format with the best overlap of labels, from SAME_LAYOUT on,
    or one new format for each set of labels. A merged format has all labels and sources; a seller or tax id that it
    lacks is the first of its samples'. Answers have source, name and status (merged or learned, by_layout or not).

    Samples are reduced to one row a key before they meet the formats, so a seller with a third of all samples is
    one row; formats are a dimension. New formats are numbered in order of their keys, by ranges.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source")))
    rows = samples.withColumn("tax_id", F.nullif(F.trim("tax_id"), F.lit(""))).withColumn("key", F.coalesce(F.concat(F.lit("t:"), "tax_id"), F.concat(F.lit("s:"), seller_key(F.col("seller"))), F.concat(F.lit("l:"), F.array_join(F.array_sort("fields"), "|"))))
    labels = rows.select("key", F.explode("fields").alias("field")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("field")).alias("fields"))  # bounded by the labels that there are
    groups = rows.groupBy("key").agg(first("tax_id").alias("tax_id"), first("seller").alias("seller"), F.array_sort(F.collect_set("source")).alias("sources")).join(labels, "key", "left")
    groups = groups.withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))

    number = F.regexp_extract("name", r"(\d+)$", 1).try_cast("long")
    known = formats.withColumn("_no", number)
    by_tax = known.where("tax_id is not null").groupBy(F.concat(F.lit("t:"), "tax_id").alias("key")).agg(F.min_by("name", "_no").alias("name"))
    taxed = groups.where("key like 't:%'").join(by_tax, "key", "left")
    by_name = known.select(F.concat(F.lit("s:"), seller_key(F.col("seller"))).alias("key"), "name", F.struct(F.lit(0).alias("late"), F.col("_no").alias("no"), F.lit("").alias("k")).alias("rank"))
    fresh = taxed.where("name is null").select(F.concat(F.lit("s:"), seller_key(F.col("seller"))).alias("key"), F.col("key").alias("name"), F.struct(F.lit(1).alias("late"), F.lit(0).cast("long").alias("no"), F.col("key").alias("k")).alias("rank"))
    by_name = by_name.unionByName(fresh).where("key is not null").groupBy("key").agg(F.min_by("name", "rank").alias("name"))
    named = groups.where("key like 's:%'").join(by_name, "key", "left")
    plain = groups.where("key like 'l:%'")
    near = best_overlap(plain.select(F.col("key").alias("id"), F.col("fields").alias("labels")), known.where("size(fields) > 0").select(F.col("_no").alias("fid"), F.col("fields").alias("labels")), SAME_LAYOUT)
    near = near.join(known.select(F.col("_no").alias("fid"), "name"), "fid").select(F.col("id").alias("key"), "name")
    found = taxed.unionByName(named).unionByName(plain.join(near, "key", "left"))

    # A group whose format is new is named by its own key until the new ones are numbered.
    found = found.withColumn("met", F.col("name").isNotNull()).withColumn("name", F.coalesce("name", "key"))
    last = known.agg(F.coalesce(F.max("_no"), F.lit(0)).alias("last")).first()[0]
    new = global_row_number(found.where("name = key").select("key"), "key", "_no", int(last) + 1)
    new = new.select("key", F.concat(F.lit("format"), F.col("_no").cast("string")).alias("given"))
    found = found.join(new.withColumnRenamed("key", "name"), "name", "left").withColumn("name", F.coalesce("given", "name")).drop("given")

    parts = known.select("name", F.lit("").alias("key"), "tax_id", "seller", "fields", "sources").unionByName(found.select("name", "key", "tax_id", "seller", "fields", "sources"))
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("key")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = parts.groupBy("name").agg(earliest("tax_id").alias("tax_id"), earliest("seller").alias("seller"), union("fields").alias("fields"), union("sources").alias("sources"))
    status = F.concat(F.when(F.col("met"), "merged").otherwise("learned"), F.when(F.col("key").startswith("l:"), "_by_layout").otherwise(""))
    answers = rows.select("source", "key").join(found.select("key", "name", status.alias("status")), "key").select("source", "name", "status")
    return merged.select(*COLUMNS), answers
