"""Form analysis on the element relation.

Containment (field in form, input in label) is an equi-join on ``page_id`` with
a position range; both sides are already partitioned by page.  Scores are kept
in whole tenths (hundredths for confidence) so that thresholds compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions import markup as M
from pagegraph.functions.text import trim_ws
from pagegraph.operators.elements import with_text
from pagegraph.session import written

# Field types by input type, and purposes by words of the action.
INPUT_TYPES = {
    "text": "Text", "email": "Email", "password": "Password", "tel": "Tel", "phone": "Tel",
    "number": "Number", "url": "Url", "search": "Search", "date": "Date", "datetime-local": "Date",
    "month": "Date", "week": "Date", "time": "Date", "checkbox": "Checkbox", "radio": "Radio",
    "file": "File", "hidden": "Hidden",
}
BUTTON_TYPES = ("submit", "button", "reset", "image")
ACTION_WORDS = {
    "Login": ("login", "signin"), "Registration": ("register", "signup"), "Search": ("search",),
    "Contact": ("contact",), "Payment": ("payment", "checkout"),
}
# Weights of hints, in tenths, and the least similarity.
HINT_TENTHS = {"id": 4, "name": 3, "label": 2, "placeholder": 1}
THRESHOLD_TENTHS = 3
FORM_TAGS = ("form", "input", "textarea", "select", "button", "label")


def may_hold_form(html: Column) -> Column:
    """Pages that spell a tag of a form: others have no such element."""
    return html.rlike("(?i)<(?:" + "|".join(FORM_TAGS) + ")")


def is_form_tag(name: Column, tok: Column) -> Column:
    """Opening tags that form analysis reads, for ``elements``."""
    return name.isin(*FORM_TAGS)


def form_elements(elems: DataFrame) -> DataFrame:
    """The elements form analysis reads: a small part of a page, written once as it is read several times."""
    return written(elems.filter(F.col("tag").isin(*FORM_TAGS)), "form-elements")


def field_type(type_attr: Column) -> Column:
    low = F.lower(type_attr)
    out = F.lit("Unknown")
    for k, v in INPUT_TYPES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def forms(elems: DataFrame) -> DataFrame:
    """``page_id, form_idx, pos, end_pos, selector, action, method``."""
    w = Window.partitionBy("page_id").orderBy("pos")
    f = elems.filter("tag = 'form'").withColumn("form_idx", F.row_number().over(w) - 1)
    return f.select(
        "page_id", "form_idx", "pos", "end_pos",
        F.concat(F.lit("form:nth-of-type("), (F.col("form_idx") + 1).cast("string"), F.lit(")")).alias("selector"),
        M.attribute(F.col("attrs"), "action").alias("action"),
        F.upper(F.coalesce(M.attribute(F.col("attrs"), "method"), F.lit("get"))).alias("method"),
    )


def _inside(outer: DataFrame, inner: DataFrame, *keep: str) -> DataFrame:
    o = outer.select(F.col("page_id").alias("o_page"), F.col("pos").alias("o_pos"), F.col("end_pos").alias("o_end"), *keep)
    return inner.join(
        o, (F.col("page_id") == F.col("o_page")) & (F.col("pos") > F.col("o_pos")) & (F.col("pos") < F.col("o_end"))
    ).drop("o_page")


def labels(elems: DataFrame, toks: DataFrame) -> DataFrame:
    """``page_id, pos, end_pos, for_id, label``: the labels of a page."""
    lab = elems.filter("tag = 'label'").select("page_id", "pos", "end_pos", "t_from", "t_to", M.attribute(F.col("attrs"), "for").alias("for_id"))
    return with_text(lab, toks, "", "label").select("page_id", "pos", "end_pos", "for_id", trim_ws(F.col("label")).alias("label"))


def resolve_labels(fields: DataFrame, elems: DataFrame, toks: DataFrame) -> DataFrame:
    """Add ``label``: by ``for``, else the first label that holds an input of the same name."""
    lab = labels(elems, toks)
    by_id = lab.filter("for_id is not null").groupBy("page_id", F.col("for_id").alias("id")).agg(F.min_by("label", "pos").alias("label_id"))
    named = elems.filter("tag = 'input'").select("page_id", "pos", M.attribute(F.col("attrs"), "name").alias("name")).filter("name is not null")
    by_name = _inside(lab, named, "label").groupBy("page_id", "name").agg(F.min_by("label", "o_pos").alias("label_name"))
    return (
        fields.join(by_id, ["page_id", "id"], "left").join(by_name, ["page_id", "name"], "left")
        .withColumn("label", F.coalesce("label_id", "label_name")).drop("label_id", "label_name")
    )


def confidence(id_: Column, name: Column, label: Column, placeholder: Column) -> Column:
    """0.5 and a share per known property, at most 1."""

    def share(c: Column, n: int) -> Column:
        return F.when(c.isNotNull(), n).otherwise(0)

    # Shares of the known properties, in hundredths.
    total = F.lit(50) + share(id_, 20) + share(name, 15) + share(label, 10) + share(placeholder, 5)
    return F.least(total, F.lit(100)) / 100


def fields(elems: DataFrame, toks: DataFrame) -> DataFrame:
    """One row per field of a form, ``ord`` its place in the form's field list.

    Inputs come first, then textareas, then selects, each in document order.
    """
    a = F.col("attrs")
    kind = F.when(F.col("tag") == "input", 0).when(F.col("tag") == "textarea", 1).otherwise(2)
    found = elems.filter(F.col("tag").isin("input", "textarea", "select")).select(
        "page_id", "pos", "tag", kind.alias("kind"),
        F.coalesce(M.attribute(a, "type"), F.lit("text")).alias("type_attr"), M.attribute(a, "name").alias("name"),
        M.attribute(a, "id").alias("id"),
        F.when(F.col("tag") != "select", M.attribute(a, "placeholder")).alias("placeholder"),
        M.attribute(a, "required").isNotNull().alias("required"),
    )
    of_form = _inside(forms(elems), found, "form_idx")
    nth = F.row_number().over(Window.partitionBy("page_id", "form_idx", "tag").orderBy("pos"))
    of_form = of_form.withColumn("nth", nth).filter((F.col("tag") != "input") | ~F.col("type_attr").isin(*BUTTON_TYPES))
    ordered = of_form.withColumn(
        "ord", F.row_number().over(Window.partitionBy("page_id", "form_idx").orderBy("kind", "pos")) - 1
    )
    by_name = F.concat(F.col("tag"), F.lit("[name='"), F.col("name"), F.lit("']"))
    by_id = F.concat(F.lit("#"), F.col("id"))
    selector = F.coalesce(by_id, by_name, F.concat(F.col("tag"), F.lit(":nth-of-type("), F.col("nth").cast("string"), F.lit(")")))
    any_name = F.when(F.col("tag") == "input", F.concat(F.lit("[name='"), F.col("name"), F.lit("']")))
    ftype = F.when(F.col("tag") == "textarea", "Textarea").when(F.col("tag") == "select", "Select").otherwise(field_type(F.col("type_attr")))
    labelled = resolve_labels(ordered, elems, toks)
    return labelled.select(
        "page_id", "form_idx", "ord", "pos", "tag", selector.alias("selector"), ftype.alias("field_type"), "label", "placeholder",
        "name", "id", "required",
        confidence(F.col("id"), F.col("name"), F.col("label"), F.col("placeholder")).alias("confidence"),
        F.array_compact(F.array(by_id, by_name, any_name)).alias("alternatives"),
    )


def purposes(form_rows: DataFrame, field_rows: DataFrame) -> DataFrame:
    """Add ``purpose`` and ``n_fields`` to forms."""
    is_type = lambda t: F.count_if(F.col("field_type") == t)
    stats = field_rows.groupBy("page_id", "form_idx").agg(
        F.count("*").alias("n"), is_type("Password").alias("pw"), is_type("Email").alias("em"), is_type("Text").alias("tx"))
    j = form_rows.join(stats, ["page_id", "form_idx"], "left").na.fill(0, ["n", "pw", "em", "tx"])
    low = F.lower("action")
    out = F.when(F.lit(False), "")
    for purpose, words in ACTION_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, purpose)
    # Which fields, and how many, tell a form's purpose.
    pw, em, tx, n = (F.col(c) for c in ("pw", "em", "tx", "n"))
    out = (
        out.when((pw > 0) & ((em > 0) | (tx == 1)) & (n <= 3), "Login")
        .when((pw > 0) & (em > 0) & (n > 3), "Registration")
        .when((n == 1) & (tx == 1), "Search").otherwise("Unknown")
    )
    return j.withColumn("purpose", out).withColumnRenamed("n", "n_fields").drop("pw", "em", "tx")


def submit_controls(elems: DataFrame) -> DataFrame:
    """``page_id, form_idx, submit_button``: best control of each form that has one."""
    t = M.attribute(F.col("attrs"), "type")
    prio = (
        F.when((F.col("tag") == "input") & (F.lower(t) == "submit"), 0)
        .when((F.col("tag") == "button") & (F.lower(t) == "submit"), 1).when(F.col("tag") == "button", 2)
    )
    c = elems.select("page_id", "pos", prio.alias("prio"), M.attribute(F.col("attrs"), "id").alias("id")).filter("prio is not null")
    plain = F.when(F.col("prio") == 0, "input[type='submit']").when(F.col("prio") == 1, "button[type='submit']").otherwise("button")
    text = F.coalesce(F.concat(F.lit("#"), F.col("id")), plain)
    return _inside(forms(elems), c, "form_idx").groupBy("page_id", "form_idx").agg(
        F.min_by(text, F.struct("prio", "pos")).alias("submit_button"))


def similarity_tenths(hint: Column) -> Column:
    """Tenths scored by the properties of a field that contain the hint."""
    low = F.lower(hint)
    total = F.lit(0)
    for col, n in HINT_TENTHS.items():
        total = total + F.when(F.contains(F.lower(col), low), n).otherwise(0)
    return total


def with_hints(field_rows: DataFrame, hints: list[str]) -> DataFrame:
    """Every field with every hint and its ``tenths``; hints are a short literal list."""
    h = F.explode(F.array(*[F.lit(x) for x in hints])).alias("hint")
    return field_rows.select("*", h).withColumn("tenths", similarity_tenths(F.col("hint")))


def best_in_form(scored: DataFrame) -> DataFrame:
    """Best field per (form, hint), the last on ties; must exceed the threshold."""
    w = Window.partitionBy("page_id", "form_idx", "hint").orderBy(F.desc("tenths"), F.desc("ord"))
    return scored.withColumn("rn", F.row_number().over(w)).filter((F.col("rn") == 1) & (F.col("tenths") > THRESHOLD_TENTHS)).drop("rn")


def best_on_page(scored: DataFrame, threshold_tenths: int = THRESHOLD_TENTHS) -> DataFrame:
    """Best field per (page, hint), the first on ties; must reach the threshold."""
    w = Window.partitionBy("page_id", "hint").orderBy(F.desc("tenths"), "form_idx", "ord")
    return scored.filter("tenths > 0").withColumn("rn", F.row_number().over(w)).filter(
        (F.col("rn") == 1) & (F.col("tenths") >= threshold_tenths)).drop("rn")


def first_by(field_rows: DataFrame, label: str, placeholder: str, ftype: str) -> DataFrame:
    """First field of a page by label, placeholder and type, with fixed confidences."""
    def hit(col: str, part: str) -> Column:
        return F.contains(F.lower(col), F.lit(part.lower()))

    rules = {"label": (hit("label", label), 1.0), "placeholder": (hit("placeholder", placeholder), 0.9), "type": (F.col("field_type") == ftype, 0.8)}
    tagged = field_rows.select("*", F.explode(F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(n).alias("found_by"), F.lit(v).alias("conf"))) for n, (c, v) in rules.items()]))).alias("r"))
    return tagged.groupBy("page_id", F.col("r.found_by").alias("found_by"), F.col("r.conf").alias("conf")).agg(
        F.min_by("selector", F.struct("form_idx", "ord")).alias("selector"))


def fill_coverage(field_rows: DataFrame, hints: list[str]) -> DataFrame:
    """Per page with fields: hints found, hints missing, success rate."""
    best = best_on_page(with_hints(field_rows, hints)).groupBy("page_id").agg(F.array_sort(F.collect_set("hint")).alias("found"))
    pages = field_rows.select("page_id").distinct().join(best, "page_id", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    wanted = F.array_sort(F.array(*[F.lit(h) for h in hints]))
    return pages.select("page_id", found.alias("filled"), F.array_except(wanted, found).alias("not_found"),
                        (F.size(found) / len(hints)).alias("success_rate"))


def form_summary(elems: DataFrame, toks: DataFrame) -> DataFrame:
    f = fields(elems, toks)
    return purposes(forms(elems), f).join(submit_controls(elems), ["page_id", "form_idx"], "left").select(
        "page_id", "form_idx", "purpose", F.col("n_fields").alias("field_count"), "action", "method", "submit_button")
