"""Saved details: names, people, placeholders, merging of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions import text as T
from pagewarden.functions.pii import ascii_edges
from pagewarden.operators.sessions import PLACEHOLDER

# Names too general to mean a person; labels whose values are never saved.
GENERIC_NAMES = ("me", "my", "i", "self", "myself", "mine", "default")
FEW_PEOPLE = 100_000  # some megabytes
_SECRET = r"(?i)pass(word|code|phrase)?\b|\bpin\b|\bcvv\b|\bcvc\b|\botp\b|one[- ]time"


def field_names(fields: DataFrame) -> DataFrame:
    """Key and label of details that have a value; a file's label says so. Values never leave."""
    label = F.when(F.col("kind") == "file", F.concat("label", F.lit(" (file to upload)"))).otherwise(F.col("label"))
    return fields.where((F.col("key") != "") & (T.trim_all(F.col("value")) != "")).select("person_id", "key", label.alias("label"))


def may_add(new: DataFrame, fields: DataFrame) -> DataFrame:
    """New details (person_id, label) that are no secret and not saved yet, with their key."""
    named = new.withColumn("key", T.slug(F.col("label"))).where((F.col("key") != "") & ~(F.col("label").rlike(ascii_edges(_SECRET)) & ~F.col("label").rlike("(?i)pin ?code")))
    return named.join(fields.select("person_id", "key").distinct(), ["person_id", "key"], "left_anti")


def _form(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")


def pick_person(tasks: DataFrame, people: DataFrame) -> DataFrame:
    """(task_id, person_id): the person named in the task (longest name), else the active one, else the first.

    Names meet tasks on their first word, and only those pairs are tested; ``people`` has person_id, name, active, pos.
    Up to FEW_PEOPLE are sent to the tasks: dealt by words, all tasks' rows of a common word would be one task's.
    """
    p = people.withColumn("_name", F.trim(_form(F.col("name")))).select("person_id", "_name", F.length("name").alias("_len"), "pos", F.split("_name", " ")[0].alias("_word"))
    usable = p.where((F.length("_name") >= 2) & ~F.col("_name").isin(*GENERIC_NAMES))
    form = F.concat(F.lit(" "), _form(F.col("task")), F.lit(" "))
    t = tasks.select("task_id", form.alias("_task"), F.explode(F.array_distinct(F.split(F.trim(form), " +"))).alias("_word"))
    hit = F.contains("_task", F.concat(F.lit(" "), F.col("_name"), F.lit(" "))) | F.contains("_task", F.concat(F.lit(" "), F.col("_name"), F.lit(" s ")))
    usable = F.broadcast(usable) if usable.limit(FEW_PEOPLE + 1).count() <= FEW_PEOPLE else usable
    named = t.join(usable, "_word").where(hit).groupBy("task_id").agg(F.min_by("person_id", F.struct((-F.col("_len")).alias("l"), F.col("pos"))).alias("named"))
    fallback = people.agg(F.coalesce(F.min_by(F.when(F.col("active"), F.col("person_id")), F.when(F.col("active"), F.col("pos"))), F.min_by("person_id", "pos")).alias("other"))
    return tasks.select("task_id").join(named, "task_id", "left").join(F.broadcast(fallback)).select("task_id", F.coalesce("named", "other").alias("person_id"))


def resolve(texts: DataFrame, fields: DataFrame) -> DataFrame:
    """Placeholders in texts (text_id, text) by saved details (key, label, value, kind, pos).

    Returns text_id, resolved, used (labels), missing (names), file (label of the last file). A name
    means the first detail with its slug as key or slugged label.
    """
    saved = fields.select("label", "value", "kind", "pos", F.explode(F.array_distinct(F.array("key", T.slug(F.col("label"))))).alias("slug"))
    first = saved.groupBy("slug").agg(F.min_by(F.struct("label", "value", "kind"), "pos").alias("f"))
    hits = F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))
    names = F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(1))
    gaps = F.split("text", PLACEHOLDER, -1)
    tokens = texts.select("text_id", F.posexplode(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), names.alias("name"))).alias("i", "t")).select("text_id", "i", "t.*")
    j = tokens.withColumn("slug", T.slug(F.col("name"))).join(first, "slug", "left")
    known = F.col("f").isNotNull() & (T.trim_all(F.col("f.value")) != "")
    piece = F.concat(F.col("gap"), F.when(F.col("hit").isNull(), "").when(known, F.col("f.value")).otherwise(F.col("hit")))
    entry = F.struct("i", piece.alias("p"), F.when(known, F.col("f.label")).alias("u"), F.when(F.col("hit").isNotNull() & ~known, F.trim("name")).alias("m"), F.when(known & (F.col("f.kind") == "file"), F.col("f.label")).alias("file"))
    rebuilt = j.groupBy("text_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    list_of = lambda k: F.filter(F.transform("e", lambda x: x[k]), lambda v: v.isNotNull())
    return rebuilt.select("text_id", F.array_join(F.transform("e", lambda x: x["p"]), "").alias("resolved"), list_of("u").alias("used"), list_of("m").alias("missing"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), list_of("file")), -1).alias("file"))


def save_answers(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Details (person_id, key, label, value, kind) with answers (person_id, label, value, seq) merged in.

    An answer's cleaned label is its key: a saved value is replaced, a new detail added as text; the last answer wins.
    """
    clean = answers.withColumn("label", T.clean_label(F.col("label"))).withColumn("key", T.slug(F.col("label"))).where("key <> ''")
    last = clean.groupBy("person_id", "key").agg(F.max_by(F.struct("label", "value"), "seq").alias("n"))
    j = fields.join(last, ["person_id", "key"], "full_outer")
    return j.select("person_id", "key", F.coalesce("label", "n.label").alias("label"), F.coalesce("n.value", "value").alias("value"), F.coalesce("kind", F.lit("text")).alias("kind"))


def with_defaults(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """Per person the default fields (key, label, pos) first, with own values where saved, then own further ones.

    ``own`` has person_id, key, label, value, pos; ``defaults`` is the contract's short list.
    """
    slots = own.select("person_id").distinct().join(F.broadcast(defaults))
    first = slots.join(own.select("person_id", "key", "value"), ["person_id", "key"], "left").select("person_id", "key", "label", F.coalesce("value", F.lit("")).alias("value"), F.lit(0).alias("part"), "pos")
    rest = own.join(F.broadcast(defaults.select("key")), "key", "left_anti").select("person_id", "key", "label", "value", F.lit(1).alias("part"), "pos")
    place = F.row_number().over(Window.partitionBy("person_id").orderBy("part", "pos")) - 1
    return first.unionByName(rest).withColumn("position", place).drop("part", "pos")


def group_fill(fields: DataFrame) -> DataFrame:
    """Per person and group: filled of total."""
    return fields.groupBy("person_id", "grp").agg(F.count_if(T.trim_all(F.col("value")) != "").alias("filled"), F.count("*").alias("total"))
