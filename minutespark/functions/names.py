"""Names of places and bodies: slugs, display forms, state suffixes, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Postal abbreviations.
STATES = dict(
    zip(
        "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah vermont virginia washington wisconsin wyoming".split(),
        "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV OH OK OR PA TN TX UT VT VA WA WI WY".split(),
        strict=True,
    )
)
ABBREVIATIONS = {"st": "saint", "mt": "mount", "ft": "fort", "twp": "township", "co": "county"}


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def base_slug(*parts: Column, longest: int = 80) -> Column:
    """Slug of the non-null parts, cut to a length, without a closing hyphen."""
    return F.regexp_replace(F.left(slug(F.concat_ws(" ", *parts)), F.lit(longest)), "-$", "")


def unique_slugs(df: DataFrame, slug_col: str, key: str) -> DataFrame:
    """The lowest key keeps a slug; others get eight hash digits of their key appended."""
    first = df.groupBy(slug_col).agg(F.min(key).alias("_first"))
    out = df.join(first, slug_col)
    tail = F.left(F.sha2(F.col(key).cast("string"), 256), F.lit(8))
    return out.withColumn(slug_col, F.when(F.col(key) == F.col("_first"), F.col(slug_col)).otherwise(F.concat(F.col(slug_col), F.lit("-"), tail))).drop("_first")


def state_suffix(name: Column) -> Column:
    """The two-letter suffix after the last comma, from an abbreviation or a state's name; else null."""
    last = F.when(F.contains(name, F.lit(",")), F.trim(F.substring_index(name, ",", -1)))
    table = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    return F.coalesce(F.when(last.rlike("^[A-Z]{2}$"), last), F.try_element_at(table, F.lower(last)))


def display(name: Column) -> Column:
    """Without a leading 'the city of', 'city of' or 'city', except before 'and county of'."""
    plain = F.regexp_replace(name, "(?i)^(the city of |city of |city )", "")
    return F.when(F.lower(name).rlike("^(the )?city and county of "), name).otherwise(plain)


def normalize(name: Column) -> Column:
    """Lower case, ascii punctuation and doubled spaces gone, abbreviations written out."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[.,'#]", " "), r"\s+", " "))
    for short, full in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return out


def candidates(name: Column) -> Column:
    """The name, it without a leading word, and it without a closing one, in this order."""
    n = normalize(name)
    return F.array_distinct(F.array(n, F.regexp_replace(n, r"^\S+ ", ""), F.regexp_replace(n, r" \S+$", "")))


def longest_known_prefix(df: DataFrame, key: str, name: str, known: DataFrame, known_name: str) -> DataFrame:
    """(key, prefix, tail): the longest run of leading words that is a known name, and what follows."""
    words = F.split(F.col(name), " ")
    cuts = df.select(key, name, F.explode(F.sequence(F.lit(1), F.size(words))).alias("n"))
    cuts = cuts.select(key, F.array_join(F.slice(words, 1, F.col("n")), " ").alias("prefix"), F.array_join(F.slice(words, F.col("n") + 1, F.size(words)), " ").alias("tail"), "n")
    hits = cuts.join(known.select(F.col(known_name).alias("prefix")).distinct(), "prefix")
    best = hits.groupBy(key).agg(F.max_by(F.struct("prefix", "tail"), "n").alias("b"))
    return best.select(key, "b.prefix", "b.tail")


def split_entity(name: Column) -> tuple[Column, Column]:
    """('X of Y') as (X, Y); (null, name) otherwise."""
    body = F.when(name.rlike(r"(?i)^.+? of .+$"), F.regexp_extract(name, r"(?i)^(.+?) of (.+)$", 1))
    return body, F.when(body.isNotNull(), F.regexp_extract(name, r"(?i)^(.+?) of (.+)$", 2)).otherwise(name)


def confidence(registry: Column, name: Column, known: Column, repaired: Column, fallback: Column) -> Column:
    """The trust ladder of a name, given what pre-joined lookups found."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    return (
        F.when(registry, "authoritative").when(blank & fallback, "fallback").when(blank, "blank").when(known, "validated").when(repaired, "repaired").when(fallback, "fallback").otherwise("unverified")
    )
