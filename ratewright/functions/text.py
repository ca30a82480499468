"""Text predicates and parsers as columns: tolerant JSON replies, label lines, addresses, types by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words about a person that evidence may not contain (fixed values).
TRAIT_WORDS = [
    "man", "men", "woman", "women", "male", "female", "boy", "girl", "he", "she", "his", "her", "hers", "gentleman", "lady", "young", "elderly", "middle-aged", "adult", "child", "teenager", "age",
    "race", "ethnicity", "religion", "sexual orientation", "political affiliation", "socioeconomic status", "attractive", "intelligent", "competent", "employable",
]
#: Words end where no ASCII letter, digit or underscore follows.
TRAITS = rf"(?i)(?<![0-9A-Za-z_])(?:{'|'.join(TRAIT_WORDS)})(?![0-9A-Za-z_])"


def strict_json(text: Column) -> Column:
    """The one JSON value a text consists of, as a variant; null if there is none or anything follows it.

    The parser ignores what follows a value, so the text is read as the only element of an array.
    """
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def reply_json(text: Column) -> tuple[Column, Column]:
    """A reply's JSON and how it was found: 'plain', 'fenced' (inside a code fence), 'sliced' (first brace to last), or null."""
    fenced = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    first, last = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    sliced = F.when((first > 0) & (last > first), F.substring(text, first, last - first + 1))
    ok = lambda c: strict_json(c).isNotNull()
    # A reply is an object; numbers and strings are JSON too, but none.
    is_object = F.ltrim(text).startswith("{")
    way = F.when(is_object & ok(text), "plain").when(text.contains("```") & F.ltrim(fenced).startswith("{") & ok(fenced), "fenced").when(ok(sliced), "sliced")
    found = F.when(way == "plain", text).when(way == "fenced", fenced).when(way == "sliced", sliced)
    return found, way


def label_problem(line: Column, v: Column) -> Column:
    """Why a JSON line with the value ``v`` (see ``strict_json``) isn't a label record, the first reason that holds; null for a record."""
    kind = F.schema_of_variant(v)
    axes = F.try_variant_get(v, "$.axes", "map<string,variant>")
    good = F.try_variant_get(v, "$.axes", "map<string,double>")
    return (
        F.when(v.isNull() & F.rtrim(line).endswith(","), "not JSON (trailing comma)")
        .when(v.isNull(), "not JSON")
        .when(~kind.startswith("OBJECT"), "not an object")
        .when(F.coalesce(F.try_variant_get(v, "$.id", "string"), F.lit("")) == "", "missing id")
        .when(axes.isNull(), "missing axes")
        .when(F.size(axes) == 0, "empty axes")
        .when(good.isNull() | F.exists(F.map_values(good), lambda x: x.isNull() | F.isnan(x)), "axis value is not a finite number")
    )


def label_lines(lines: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """``(records, problems)`` of JSON lines: id, cluster, rater, axes as a map; every other non-blank line with its reason."""
    # inline, not a plain projection: each line is parsed once, as no filter is pushed below it.
    parsed = lines.where(F.trim(line) != "").select("*", F.inline(F.array(F.struct(strict_json(F.col(line)).alias("__v")))))
    v = F.col("__v")
    rows = parsed.select("*", label_problem(F.col(line), v).alias("__why"))
    text = lambda p: F.nullif(F.try_variant_get(v, p, "string"), F.lit(""))
    good = rows.where("__why is null").select(*[c for c in lines.columns if c != line], text("$.id").alias("id"), text("$.clusterId").alias("cluster"), text("$.rater").alias("rater"), F.try_variant_get(v, "$.axes", "map<string,double>").alias("axes"))
    return good, rows.where("__why is not null").select(*lines.columns, F.col("__why").alias("reason"))


def mime_of(content: Column) -> Column:
    """Type of an image by its first bytes; null for anything else."""
    return (
        F.when(F.hex(F.substring(content, 1, 3)) == "FFD8FF", "image/jpeg")
        .when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", "image/png")
        .when((F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "image/webp")
        .when((F.hex(F.substring(content, 5, 4)) == "66747970") & F.decode(F.substring(content, 9, 4), "ISO-8859-1").isin("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1"), "image/heif")
    )


def client_address(forwarded: Column, real: Column) -> Column:
    """Leftmost forwarded address, else the real one, else null."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), F.nullif(F.trim(real), F.lit("")))


def extension(path: Column) -> Column:
    """Lower-case image extension (jpg, jpeg, png or webp) at the end of an address or before its query; 'jpg' if there is none."""
    e = F.lower(F.regexp_extract(path, r"(?i)\.(jpe?g|png|webp)(?:\?|\z)", 1))
    return F.when(e == "", "jpg").otherwise(e)


def csv_line(columns: list[Column]) -> Column:
    """Columns as one CSV line: line breaks flattened, quoted only where needed, quotes doubled; null as empty."""
    out = []
    for c in columns:
        s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
        out.append(F.when(s.rlike('[",]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s))
    return F.concat_ws(",", *out)


def vector_text(v: Column) -> Column:
    """``[a,b,…]`` of an array, null for null."""
    return F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]")))


def safe_path(path: Column, base: str) -> Column:
    """Whether a path stays out of ``base`` once separators are unified and '.' and '..' are resolved."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    resolved = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p))))
    joined = F.array_join(resolved, "/")
    return ~((joined == base.strip("/")) | joined.startswith(base.strip("/") + "/"))
