"""File names, labels and cells as written by people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: region names in matching order, spellings and markers seen in the data
ROIS = ("forniceal_palpebral", "forniceal", "palpebral")
ROI_TYPOS = {
    "papebral": "palpebral",
    "palpebaral": "palpebral",
    "palpebal": "palpebral",
    "palplebral": "palpebral",
    "palpebralal": "palpebral",
    "fornicial": "forniceal",
    "forniceel": "forniceal",
    "fornical": "forniceal",
}
MISSING_MARKERS = ("", "_", "-", "--", "n/a", "na", "nan", "none", "null")
WITHDRAWN_MARKERS = ("eliminato", "eliminata", "excluded", "exclude", "removed", "drop")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
LABEL_ALIASES = {
    "patient_id": ("number", "patientid", "patient", "id", "subject", "subjectid", "code", "casename",
                   "patientnumber", "recnumber", "n"),
    "hb": ("hb", "hgb", "hbgdl", "hemoglobin", "haemoglobin", "hbvalue", "hbconc"),
    "sex": ("sex", "gender", "s", "sexo"),
    "age": ("age", "ageyears", "years", "eta"),
    "site": ("site", "country", "location", "centre", "center", "institution"),
    "note": ("note", "notes", "comment", "comments", "remark", "remarks"),
}
PREDICTION_ALIASES = {
    "y_true": ("ytrue", "hbtrue", "hb", "true", "y"),
    "y_pred": ("ypred", "hbpred", "hbhat", "pred", "prediction"),
}
SITES = ("India", "Italy")
SITE_STEMS = {"India": "india", "Italy": "ital"}
# ------------------------------------------------------------------------------

VARIANT = r"\(\d+\)$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def first_of(choices: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds."""
    head, *rest = choices
    return reduce(lambda chain, c: chain.when(c[0], c[1]), rest, F.when(head[0], head[1]))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def is_image(name: Column) -> Column:
    return suffix(name).isin(*IMAGE_SUFFIXES)


def near(a: Column, b: str) -> Column:
    """At most one edit apart; Spark stops counting beyond the threshold."""
    return F.levenshtein(a, F.lit(b), 1) >= 0


def mask_roi(name_stem: Column) -> Column:
    """The region a mask file belongs to, NULL for a photograph.

    A trailing ``(n)`` is dropped. An exact ending wins, the longest first; then
    the last word is corrected by the known spellings or by one edit and the
    ending is read again; last, the whole stem may be one edit away.
    """
    plain = F.regexp_replace(F.lower(name_stem), VARIANT, "")
    tail = F.substring_index(plain, "_", -1)
    typos = F.create_map(*[F.lit(x) for pair in ROI_TYPOS.items() for x in pair])
    close = [(near(tail, roi) & (F.length(tail) > 3), F.lit(roi)) for roi in ROIS]
    fixed = F.coalesce(F.try_element_at(typos, tail), first_of(close))
    combined = plain.endswith(F.concat(F.lit("forniceal_"), tail)) & (fixed == "palpebral")
    exact = [(plain.endswith(roi), F.lit(roi)) for roi in ROIS]
    whole = [(near(plain, roi), F.lit(roi)) for roi in ROIS]
    return first_of([*exact, (combined, F.lit(ROIS[0])), (fixed.isNotNull(), fixed), *whole])


def mask_rank(name: Column) -> Column:
    """Smaller is better: no ``(n)``, then shorter, then by name."""
    copied = F.rlike(stem(name), F.lit(VARIANT)).cast("int")
    return F.struct(copied.alias("copied"), F.length(name).alias("size"), name.alias("name"))


def parse_label(cell: Column) -> Column:
    """(value, reason) of one label cell; a decimal comma is a decimal point.

    Cells that could be read two ways are refused, not guessed.
    """
    text = F.trim(cell)
    dotted = F.regexp_replace(text, "^([^,]*),", "$1.")
    number = F.when(F.rlike(dotted, F.lit(NUMBER)), dotted.try_cast("double"))
    reason = first_of(
        [
            (cell.isNull() | F.lower(text).isin(*MISSING_MARKERS), F.lit("missing")),
            (F.contains(text, F.lit(".")) & F.contains(text, F.lit(",")), F.lit("ambiguous")),
            (F.rlike(text, F.lit("^[+-]*[0-9]+,[0-9]{2,}$")), F.lit("thousands")),
            (number.isNull() | (F.abs(number) == float("inf")), F.lit("not_a_number")),
        ]
    )
    return F.struct(F.when(reason.isNull(), number).alias("value"), reason.alias("reason"))


def withdrawn(columns: list[str]) -> Column:
    """(marker, column) of the first marker found in any column, else NULL."""
    found = [
        (
            F.contains(F.lower(F.col(c)), F.lit(m)),
            F.struct(F.lit(m).alias("marker"), F.lit(c).alias("column")),
        )
        for c in columns
        for m in WITHDRAWN_MARKERS
    ]
    return first_of([(F.coalesce(test, F.lit(False)), value) for test, value in found])


def normal_sex(cell: Column) -> Column:
    text = F.lower(F.trim(cell))
    return F.when(text.startswith("m"), "M").when(text.startswith("f"), "F").otherwise("unknown")


def normal_site(cell: Column, sites: tuple[str, ...] = SITES, stems: dict[str, str] = SITE_STEMS) -> Column:
    """A site is named in full anywhere in the text, or by its stem."""
    text = F.lower(F.trim(cell))
    full = [(F.contains(text, F.lit(s.lower())), F.lit(s)) for s in sites]
    short = [(F.contains(text, F.lit(stem_)), F.lit(s)) for s, stem_ in stems.items()]
    return F.coalesce(first_of([*full, *short]), F.lit("unknown"))


def number_key(cell: Column) -> Column:
    """Folder and sheet numbers meet here: leading zeros and decimals (``93.0``) are dropped."""
    text = F.trim(cell)
    whole = F.regexp_replace(F.regexp_replace(text, r"\.[0-9]*$", ""), "^0+(?=[0-9])", "")
    return F.when(F.rlike(text, F.lit(r"^[0-9]+(\.[0-9]*)?$")), whole).otherwise(text)


def qualified(site: Column, local: Column) -> Column:
    return F.concat_ws("/", site, local)


def local_number(patient_id: Column) -> Column:
    return F.coalesce(F.substring_index(patient_id, "/", -1).try_cast("long"), F.lit(0))


def age_value(cell: Column) -> Column:
    text = F.trim(cell)
    age = F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))
    return F.when(F.abs(age) < float("inf"), age)


def candidate_label(kind: Column, roi: Column, balance: Column) -> Column:
    return F.when(kind == "deep", F.concat_ws(" / ", kind, roi)).otherwise(F.concat_ws(" / ", kind, roi, balance))


def cache_key(kind: Column, roi: Column, balance: Column) -> Column:
    return F.concat_ws("/", kind, roi, balance)
