"""Labels and texts: normal forms, how two labels relate, redaction."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Mail addresses and telephone-like runs of digits.
SECRETS = (r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", r"[0-9]{3}-[0-9]{4}")


def folded(label: Column) -> Column:
    """Compatibility-composed, case-folded, white space collapsed; Spark has no function for the first two. The function
    is a nested one, so that it goes to the executors by value."""

    def fold(labels: pd.Series) -> pd.Series:
        return labels.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))

    return pandas_udf(fold, StringType())(label)


def relation(a: Column, b: Column, modifiers: list[str], related: list[tuple[str, str]]) -> Column:
    """same; refinement, where one ends with the other and its words before are all modifiers; related, where the pair is
    declared; different."""
    words_a, words_b = F.split(a, " "), F.split(b, " ")
    known = F.array(*map(F.lit, modifiers))

    def refines(long: Column, short: Column) -> Column:
        extra = F.size(long) - F.size(short)
        tail = F.slice(long, F.greatest(extra, F.lit(0)) + 1, F.size(short))
        return (extra > 0) & (tail == short) & F.forall(F.slice(long, 1, F.greatest(extra, F.lit(0))), lambda w: F.array_contains(known, w))

    declared = F.lit(False)
    for x, y in related:
        declared |= ((a == x) & (b == y)) | ((a == y) & (b == x))
    return F.when(a == b, "same").when(refines(words_a, words_b) | refines(words_b, words_a), "refinement").when(declared, "related").otherwise("different")


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[redacted]")
    return text


#: Keys whose values are secrets, at whatever depth of a JSON text.
SECRET_KEYS = ("secret", "token", "password", "api_key")


def redact_json(text: Column) -> Column:
    """A JSON text with the values of secret keys replaced, whatever objects they are in, and secrets in other texts too."""
    keys = "|".join(SECRET_KEYS)
    value = r'("(?:[^"\\]|\\.)*"|[^,\[{}\]\s]+)'
    return redact(F.regexp_replace(text, rf'(?i)("[^"]*(?:{keys})[^"]*"\s*:\s*){value}', '$1"[redacted]"'))


def render(template: str, **values: Column) -> Column:
    """A text with ``{name}`` replaced by the columns' values, null by nothing; doubled braces are braces. A name without a value, or a value
    without a place, is an error."""
    import string

    parts, used = [], set()
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in values:
                raise ValueError(f"the template asks for {name!r}")
            used.add(name)
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    if unused := sorted(set(values) - used):
        raise ValueError(f"the template has no place for {unused}")
    return F.concat(*parts) if parts else F.lit("")


def rendered(template: str, **values: Column) -> Column:
    """struct<prompt, fingerprint>: the fingerprint is of template and values, parted so that no two give the same."""
    text = F.concat_ws("\u0001", F.lit(template), *[F.concat(F.lit(n), F.lit("\u0002"), F.coalesce(v.cast("string"), F.lit("\u0003"))) for n, v in sorted(values.items())])
    return F.struct(render(template, **values).alias("prompt"), F.sha2(text, 256).alias("fingerprint"))


CLAIM = "struct<label:string,role:string,confidence:double>"


def parse_response(text: Column, *, region: bool = True, scored: bool = True) -> Column:
    """struct<abstained, claims, problem> of a model's answer: JSON with the keys claims (label, role, confidence) and, if it likes, abstained; one
    code fence about it goes. ``problem`` is the first of: empty, not_json, wrong_keys (others than these, or no claims), wrong_claim
    (without a label, or of a role other than primary and alternative), abstained_with_claims, no_claim, not_one_primary (of a
    region), confidence (outside 0 to 1, or there although nothing is ``scored``); null where all is well. Then claims is null."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?[ \t]*\r?\n(.*?)\r?\n```$", "$1"))
    out = F.transform(F.array(F.struct(bare.alias("j"))), lambda a: F.struct(a["j"].alias("j"), F.from_json(a["j"], f"abstained boolean, claims array<{CLAIM}>").alias("o"), F.json_object_keys(a["j"]).alias("k"), F.try_parse_json(a["j"]).isNotNull().alias("ok")))

    def judge(a: Column) -> Column:
        claims, said = a["o"]["claims"], F.coalesce(a["o"]["abstained"], F.lit(False))
        wrong = F.exists(claims, lambda c: (F.coalesce(F.trim(c["label"]), F.lit("")) == "") | ~F.coalesce(c["role"].isin("primary", "alternative"), F.lit(False)))
        sure = F.exists(claims, lambda c: c["confidence"].isNotNull() & (F.lit(not scored) | F.isnan(c["confidence"]) | ~c["confidence"].between(0, 1)))
        primary = F.size(F.filter(claims, lambda c: c["role"] == "primary"))
        others = F.array_except(a["k"], F.array(F.lit("claims"), F.lit("abstained")))
        problem = (
            F.when(F.coalesce(a["j"], F.lit("")) == "", "empty")
            .when(~a["ok"] | a["k"].isNull(), "not_json")
            .when((F.size(others) > 0) | claims.isNull(), "wrong_keys")
            .when(wrong, "wrong_claim")
            .when(said & (F.size(claims) > 0), "abstained_with_claims")
            .when(~said & (F.size(claims) == 0), "no_claim")
            .when(F.lit(region) & ~said & (primary != 1), "not_one_primary")
            .when(sure, "confidence")
        )
        return F.struct(F.when(problem.isNull(), said).alias("abstained"), F.when(problem.isNull(), claims).alias("claims"), problem.alias("problem"))

    return F.transform(out, judge)[0]


def region_reasons(area: Column, valid: Column, excluded: Column, least: int, most: int, min_valid: float, max_excluded: float) -> Column:
    """Why a region is not taken, the first of too_small, too_large, outside_valid_region and in_exclusion; null where it is. ``valid`` and
    ``excluded`` are pixels of its area."""
    return F.when(area < least, "too_small").when(area > most, "too_large").when(valid / area < min_valid, "outside_valid_region").when(excluded / area > max_excluded, "in_exclusion")


def tiles(width: Column, height: Column, size: int, overlap: int) -> Column:
    """array<struct<tile, x, y, width, height>>: the whole image first, as tile 0, then, where it is larger than one, tiles of ``size`` that overlap,
    by rows, the last of a row or column flush with the edge."""
    step = size - overlap

    def starts(length: Column) -> Column:
        last = F.when(length <= size, F.lit(0)).otherwise(F.ceil((length - size) / F.lit(float(step)))).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.greatest(F.least(i * step, length - size), F.lit(0)).cast("int"))

    cells = F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.struct(x.alias("x"), y.alias("y")))))
    made = F.transform(cells, lambda c, i: F.struct((i + 1).cast("int").alias("tile"), c["x"].alias("x"), c["y"].alias("y"), F.least(width, F.lit(size)).cast("int").alias("width"), F.least(height, F.lit(size)).cast("int").alias("height")))
    whole = F.struct(F.lit(0).alias("tile"), F.lit(0).alias("x"), F.lit(0).alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))
    return F.concat(F.array(whole), F.when(F.size(cells) > 1, made).otherwise(F.array().cast("array<struct<tile:int,x:int,y:int,width:int,height:int>>")))


def cut_by_tile(x0: Column, x1: Column, y0: Column, y1: Column, tile: Column, width: Column, height: Column) -> Column:
    """Whether a region, in its tile's pixels, touches an edge of the tile that is none of the image's: it may be cut there."""
    left, top = (x0 <= 0) & (tile["x"] > 0), (y0 <= 0) & (tile["y"] > 0)
    right, bottom = (x1 >= tile["width"] - 1) & (tile["x"] + tile["width"] < width), (y1 >= tile["height"] - 1) & (tile["y"] + tile["height"] < height)
    return left | top | right | bottom


#: Bytes of a pixel by encoding.
PIXEL = {"mono8": 1, "mono16": 2, "rgb8": 3, "bgr8": 3, "rgba8": 4, "bgra8": 4}


def structural_problems(modality: Column, width: Column, height: Column, encoding: Column, data_bytes: Column, n_points: Column, step: Column, fields: Column) -> Column:
    """array of all that is wrong with a record: image_bytes (not width * height pixels of its encoding), unknown_encoding, cloud_bytes (not points *
    step), duplicate_field and field_beyond_point; empty where nothing is. ``fields``: array<struct<name, offset, bytes>>."""
    size = F.create_map(*[F.lit(x) for kv in PIXEL.items() for x in kv])[encoding]
    image, cloud = modality == "image", modality == "cloud"
    names = F.transform(fields, lambda f: f["name"])
    found = (
        F.when(image & size.isNull(), "unknown_encoding"),
        F.when(image & (width * height * size != data_bytes), "image_bytes"),
        F.when(cloud & (n_points * step != data_bytes), "cloud_bytes"),
        F.when(cloud & (F.size(F.array_distinct(names)) < F.size(names)), "duplicate_field"),
        F.when(cloud & F.exists(fields, lambda f: (f["offset"] < 0) | (f["offset"] + f["bytes"] > step)), "field_beyond_point"),
    )
    return F.array_compact(F.array(*found))


def image_chain(u: Column, v: Column, size: tuple[int, int], steps: list[tuple]) -> tuple[Column, Column, Column]:
    """(u, v, inside) of a raw pixel in the prepared image, through ("crop", x, y, width, height), ("resize", width, height) and ("normalize",), which
    moves nothing, in turn. Pixels' centres are whole; the image reaches from -0.5, included, to its size less 0.5. Rectified images
    are refused, as their pixels do not follow from the raw ones by these."""
    width, height = size
    for name, *numbers in steps:
        if name == "crop":
            x, y, w, h = numbers
            if x < 0 or y < 0 or x + w > width or y + h > height:
                raise ValueError(f"the crop {numbers} is not within {width} x {height}")
            u, v, width, height = u - x, v - y, w, h
        elif name == "resize":
            w, h = numbers
            u, v = (u + 0.5) * (w / width) - 0.5, (v + 0.5) * (h / height) - 0.5
            width, height = w, h
        elif name != "normalize":
            raise ValueError(f"no pixels can be followed through {name!r}")
    return u, v, (u >= -0.5) & (u < width - 0.5) & (v >= -0.5) & (v < height - 0.5)
