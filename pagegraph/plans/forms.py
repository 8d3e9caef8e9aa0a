"""Queries on forms."""

from pyspark.sql import functions as F

from pagegraph.operators import elements as E
from pagegraph.operators import forms as FM
from pagegraph.plans import duck as D
from pagegraph.plans.inputs import site_pages
from pagegraph.plans.registry import CTES, query

HINTS = ["email", "user", "name", "message", "search", "pw", "zip"]


def base(t):
    toks = E.page_tokens(site_pages(t).filter(FM.may_hold_form(F.col("html"))))
    return FM.form_elements(E.elements(toks, FM.is_form_tag)), toks


def fields(t):
    return FM.fields(*base(t))


A = lambda n: D.attr("attrs", n)
CTES["forms"] = f"""SELECT page_id, pos, end_pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS form_idx,
  {A('action')} AS action, upper(coalesce({A('method')}, 'get')) AS method FROM elems WHERE tag = 'form'"""
CTES["controls"] = f"""SELECT page_id, pos, tag, coalesce({A('type')}, 'text') AS type_attr, {A('type')} AS raw_type, {A('name')} AS name, {A('id')} AS id,
  CASE WHEN tag <> 'select' THEN {A('placeholder')} END AS placeholder, {A('required')} IS NOT NULL AS required
  FROM elems WHERE tag IN ('input', 'textarea', 'select', 'button')"""
CTES["labels_of"] = f"""SELECT page_id, pos, end_pos, {A('for')} AS for_id, {D.trim_ws(D.span_text(''))} AS label
  FROM elems JOIN page_texts USING (page_id) WHERE tag = 'label'"""
CTES["in_form"] = """SELECT c.*, f.form_idx, row_number() OVER (PARTITION BY c.page_id, form_idx, tag ORDER BY c.pos) AS nth
  FROM controls c JOIN forms f ON f.page_id = c.page_id AND c.pos > f.pos AND c.pos < f.end_pos"""
_FT = "CASE " + " ".join(f"WHEN lower(type_attr) = '{k}' THEN '{v}'" for k, v in FM.INPUT_TYPES.items()) + " ELSE 'Unknown' END"
CTES["fields"] = f"""SELECT *,
  0.5 + CASE WHEN id IS NULL THEN 0 ELSE 0.2 END + CASE WHEN name IS NULL THEN 0 ELSE 0.15 END + CASE WHEN label IS NULL THEN 0 ELSE 0.1 END
    + CASE WHEN placeholder IS NULL THEN 0 ELSE 0.05 END AS confidence FROM (
  SELECT i.page_id, i.form_idx, i.pos, i.tag, i.nth, i.name, i.id, i.placeholder, i.required, i.type_attr,
    row_number() OVER (PARTITION BY i.page_id, i.form_idx ORDER BY CASE tag WHEN 'input' THEN 0 WHEN 'textarea' THEN 1 ELSE 2 END, i.pos) - 1 AS ord,
    CASE tag WHEN 'textarea' THEN 'Textarea' WHEN 'select' THEN 'Select' ELSE {_FT} END AS field_type,
    coalesce((SELECT min_by(l.label, l.pos) FROM labels_of l WHERE l.page_id = i.page_id AND l.for_id = i.id),
      (SELECT min_by(l.label, l.pos) FROM labels_of l JOIN controls x ON x.page_id = l.page_id AND x.tag = 'input' AND x.pos > l.pos AND x.pos < l.end_pos
        WHERE l.page_id = i.page_id AND x.name = i.name)) AS label,
    coalesce('#' || i.id, i.tag || '[name=''' || i.name || ''']', i.tag || ':nth-of-type(' || i.nth || ')') AS selector
  FROM in_form i WHERE tag <> 'button' AND NOT (tag = 'input' AND type_attr IN {D.in_list(FM.BUTTON_TYPES)}))"""


@query("page_forms", "SELECT page_id, form_idx, 'form:nth-of-type(' || (form_idx + 1) || ')' AS selector, action, method FROM forms")
def page_forms(t):
    return FM.forms(base(t)[0]).select("page_id", "form_idx", "selector", "action", "method")


@query("form_fields", """SELECT page_id, form_idx, ord, selector, field_type, label, placeholder, name, id, required,
  concat_ws(' | ', '#' || id, tag || '[name=''' || name || ''']', CASE WHEN tag = 'input' THEN '[name=''' || name || ''']' END) AS alternatives FROM fields""")
def form_fields(t):
    return fields(t).withColumn("alternatives", F.array_join("alternatives", " | ")).select(
        "page_id", "form_idx", "ord", "selector", "field_type", "label", "placeholder", "name", "id", "required", "alternatives")


@query("field_type", f"SELECT page_id, pos, type_attr, {_FT} AS field_type FROM controls WHERE tag = 'input'")
def field_type(t):
    from pagegraph.functions import markup as M

    e = base(t)[0].filter("tag = 'input'").select("page_id", "pos", F.coalesce(M.attribute(F.col("attrs"), "type"), F.lit("text")).alias("type_attr"))
    return e.withColumn("field_type", FM.field_type(F.col("type_attr")))


@query("field_labels", "SELECT page_id, form_idx, ord, label FROM fields WHERE label IS NOT NULL")
def field_labels(t):
    return fields(t).filter("label is not null").select("page_id", "form_idx", "ord", "label")


@query("field_confidence", "SELECT page_id, form_idx, ord, CAST(least(confidence, 1) AS DOUBLE) AS confidence FROM fields")
def field_confidence(t):
    return fields(t).select("page_id", "form_idx", "ord", "confidence")


def _words(p):
    return " OR ".join(f"contains(lower(action), '{w}')" for w in FM.ACTION_WORDS[p])


CTES["purposes"] = f"""SELECT f.page_id, f.form_idx, any_value(f.action) AS action, any_value(f.method) AS method, count(x.ord) AS n_fields,
  CASE {' '.join(f"WHEN bool_or({_words(p)}) THEN '{p}'" for p in FM.ACTION_WORDS)}
    WHEN count_if(field_type = 'Password') > 0 AND (count_if(field_type = 'Email') > 0 OR count_if(field_type = 'Text') = 1) AND count(x.ord) <= 3 THEN 'Login'
    WHEN count_if(field_type = 'Password') > 0 AND count_if(field_type = 'Email') > 0 AND count(x.ord) > 3 THEN 'Registration'
    WHEN count(x.ord) = 1 AND count_if(field_type = 'Text') = 1 THEN 'Search' ELSE 'Unknown' END AS purpose
  FROM forms f LEFT JOIN fields x ON x.page_id = f.page_id AND x.form_idx = f.form_idx GROUP BY f.page_id, f.form_idx"""
CTES["submits"] = """SELECT page_id, form_idx, arg_min(coalesce('#' || id, CASE prio WHEN 0 THEN 'input[type=''submit'']' WHEN 1 THEN 'button[type=''submit'']' ELSE 'button' END), prio * 1000000 + pos) AS submit_button
  FROM (SELECT *, CASE WHEN tag = 'input' AND lower(raw_type) = 'submit' THEN 0 WHEN tag = 'button' AND lower(raw_type) = 'submit' THEN 1 WHEN tag = 'button' THEN 2 END AS prio FROM in_form)
  WHERE prio IS NOT NULL GROUP BY page_id, form_idx"""


@query("form_purpose", "SELECT page_id, form_idx, purpose, n_fields FROM purposes")
def form_purpose(t):
    e, k = base(t)
    return FM.purposes(FM.forms(e), FM.fields(e, k)).select("page_id", "form_idx", "purpose", "n_fields")


@query("form_submit", "SELECT page_id, form_idx, submit_button FROM submits")
def form_submit(t):
    return FM.submit_controls(base(t)[0])


CTES["hints"] = f"SELECT unnest([{', '.join(D.q(h) for h in HINTS)}]) AS hint"
CTES["scored_fields"] = "SELECT f.*, hint, " + " + ".join(
    f"CASE WHEN contains(lower({c}), hint) THEN {n} ELSE 0 END" for c, n in FM.HINT_TENTHS.items()) + " AS tenths FROM fields f, hints"
CTES["best_fields"] = """SELECT page_id, hint, selector, tenths FROM scored_fields WHERE tenths >= 3
  QUALIFY row_number() OVER (PARTITION BY page_id, hint ORDER BY tenths DESC, form_idx, ord) = 1"""


@query("field_similarity", "SELECT page_id, form_idx, ord, hint, tenths / 10 AS score FROM scored_fields")
def field_similarity(t):
    return FM.with_hints(fields(t), HINTS).select("page_id", "form_idx", "ord", "hint", (F.col("tenths") / 10).alias("score"))


@query("find_field", """SELECT page_id, form_idx, hint, selector FROM scored_fields
  QUALIFY row_number() OVER (PARTITION BY page_id, form_idx, hint ORDER BY tenths DESC, ord DESC) = 1 AND tenths > 3""")
def find_field(t):
    return FM.best_in_form(FM.with_hints(fields(t), HINTS)).select("page_id", "form_idx", "hint", "selector")


@query("match_field_page", "SELECT page_id, hint, selector, tenths / 10 AS score FROM best_fields")
def match_field_page(t):
    return FM.best_on_page(FM.with_hints(fields(t), HINTS)).select("page_id", "hint", "selector", (F.col("tenths") / 10).alias("score"))


@query("first_field_by", """SELECT page_id, found_by, conf, arg_min(selector, form_idx * 100000 + ord) AS selector FROM (
  SELECT *, 'label' AS found_by, 1.0::DOUBLE AS conf FROM fields WHERE contains(lower(label), 'mail')
  UNION ALL SELECT *, 'placeholder', 0.9 FROM fields WHERE contains(lower(placeholder), 'email')
  UNION ALL SELECT *, 'type', 0.8 FROM fields WHERE field_type = 'Password') GROUP BY page_id, found_by, conf""")
def first_field_by(t):
    return FM.first_by(fields(t), "Mail", "EMAIL", "Password")


@query("fields_by_type", "SELECT page_id, form_idx, selector FROM fields WHERE field_type = 'Email'")
def fields_by_type(t):
    return fields(t).filter("field_type = 'Email'").select("page_id", "form_idx", "selector")


@query("fill_coverage", f"""SELECT p.page_id, coalesce(string_agg(hint, ',' ORDER BY hint) FILTER (WHERE b.page_id IS NOT NULL), '') AS filled,
  count(b.page_id) AS n_filled, count(b.page_id) / {len(HINTS)} AS success_rate
  FROM (SELECT DISTINCT page_id FROM fields) p CROSS JOIN hints h LEFT JOIN best_fields b USING (page_id, hint) GROUP BY p.page_id""")
def fill_coverage(t):
    return FM.fill_coverage(fields(t), HINTS).select(
        "page_id", F.array_join("filled", ",").alias("filled"), F.size("filled").alias("n_filled"), "success_rate")


@query("form_summary", """SELECT page_id, form_idx, purpose, n_fields AS field_count, action, method, submit_button
  FROM purposes LEFT JOIN submits USING (page_id, form_idx)""")
def form_summary(t):
    return FM.form_summary(*base(t))
