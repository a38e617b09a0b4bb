"""Form filling plans: fields linked to actions, steps per field, blockers, questions, answers, and replayed executions.

Linking is greedy in field order (an action taken is gone for later fields), so it runs per page over the arrays of its
few fields and actions, in Arrow batches; everything else is conditions over the linked fields.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import fold, folded, ratio

#: Kinds that a profile fills, keys that it may have, those it should have, and the aliases of kinds.
SAFE = ("email", "name", "first_name", "last_name", "company", "role", "phone")
KNOWN_KEYS = ("email", "name", "full_name", "first_name", "last_name", "company", "role", "job_title", "phone", "tel")
RECOMMENDED_KEYS = ("email", "name")
ALIASES = {
    "email": ("email", "e-mail", "mail", "work email", "business email"),
    "name": ("name", "full name", "your name", "display name"),
    "first_name": ("first name", "firstname", "given name"),
    "last_name": ("last name", "lastname", "surname", "family name"),
    "company": ("company", "organization", "organisation", "employer", "business"),
    "role": ("role", "job title", "title", "position", "job"),
    "phone": ("phone", "telephone", "mobile", "cell", "tel"),
}
#: Labels of robot checks, of other sites' logins, of open questions, of validation messages; email texts.
BLOCKER = r"(?iuU)\b(captcha|recaptcha|hcaptcha|turnstile|verify you are human|i'?m not a robot)\b"
OAUTH = r"(?iuU)\b(sign in with|log in with|continue with|login with)\s+(google|github|apple|microsoft|facebook|sso|oauth)\b|^(google|github|apple|microsoft|facebook)$"
AMBIGUOUS = r"(?iuU)\b(how did you hear|referr|message|comment|bio|description|reason|why|notes|website|url|address line)\b"
MESSAGE = r"(?iuU)\b(invalid|required|must be|please enter|please provide|error|too short|too long|format)\b"
EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
SUBMIT_WORDS = ("submit", "sign up", "register", "continue", "next", "create")
#: Similarity from which a link takes its action, and that of a submit button.
TAKEN, SUBMIT_LIKE = 0.45, 0.4


def field_kind() -> Column:
    """The kind of a field from type, tag and the folded text `blob` of its label, name and placeholder."""
    kind, tag, blob = F.lower(F.coalesce("type", F.lit("text"))), F.lower(F.coalesce("tag", F.lit("input"))), F.col("blob")
    out = (
        F.when(kind.isin("hidden", "file", "password", "checkbox", "email"), kind)
        .when(kind.isin("date", "datetime-local", "time", "month", "week"), "date")
        .when((tag == "textarea") | (kind == "textarea"), "textarea")
        .when((tag == "select") | (kind == "select"), "select")
        .when(kind == "tel", "phone")
        .when(blob.rlike(BLOCKER), "captcha")
        .when(blob.rlike(OAUTH), "oauth")
    )
    # Long aliases first, so that a company's name is no name; a text that is part of an alias counts, even an empty one.
    for name, alias in sorted(((k, a) for k, names in ALIASES.items() for a in names), key=lambda x: -len(x[1])):
        out = out.when(F.contains(blob, F.lit(alias)) | F.contains(F.lit(alias), blob), name)
    return out.otherwise("unknown")


def _blob(*names: str) -> Column:
    return folded(F.concat_ws(" ", *[F.when(F.col(n) != "", F.col(n)) for n in names]))


def _same_kind(kind: str, tag: str, action: str) -> bool:
    """Whether an action of that type can be the field."""
    inner = action[6:-1] if action.startswith("input[") else None
    return action == tag in ("textarea", "select") or inner == kind or (action == "input" and kind == "text") or (action == "button" and kind == "submit")


def _linked(fields: list[dict], acts: list[dict]) -> list[dict]:
    """For each field of one form, in order, the best action that is still free."""
    taken: set[str] = set()
    out = []
    for f in fields:
        sid, best = None, 0.0
        for a in acts:
            if a["id"] in taken or not _same_kind((f["type"] or "text").lower(), (f["tag"] or "input").lower(), (a["type"] or "").lower()):
                continue
            score = max(ratio(f["blob"], a["ablob"]), ratio(fold(f["name"]), a["ablob"]) if f["name"] else 0.0)
            if score > best:
                sid, best = a["id"], score
        if sid is not None and best >= TAKEN:
            taken.add(sid)
        out.append({"sid": sid, "match_score": best})
    return out


def _submit(buttons: list[dict], acts: list[dict], links: list[dict]) -> str | None:
    """The action that submits the form: like one of its submit fields, else the first button that says so."""
    used = {x["sid"] for x in links}
    free = [a for a in acts if a["id"] not in used]
    for f in buttons:
        for a in free:
            if (a["type"] or "").lower() in ("button", "input[submit]") and ratio(f["blob"], a["ablob"]) >= SUBMIT_LIKE:
                return a["id"]
    return next((a["id"] for a in free if (a["type"] or "").lower() == "button" and any(w in a["ablob"] for w in SUBMIT_WORDS)), None)


_LINKS = T.StructType([T.StructField("links", T.ArrayType(T.StructType([T.StructField("sid", T.StringType()), T.StructField("match_score", T.DoubleType())]))), T.StructField("submit", T.StringType())])


@F.arrow_udf(_LINKS)
def _link(fields: pa.Array, acts: pa.Array) -> pa.Array:
    out = []
    for own, told in zip(fields.to_pylist(), acts.to_pylist(), strict=True):
        own, told = own or [], told or []
        links = _linked([f for f in own if not f["submits"]], told)
        out.append({"links": links, "submit": _submit([f for f in own if f["button"]], told, links)})
    return pa.array(out, pa.struct([("links", pa.list_(pa.struct([("sid", pa.string()), ("match_score", pa.float64())]))), ("submit", pa.string())]))


def _never_broadcast(rows: DataFrame) -> DataFrame:
    """rows of every page, for a join by page that sorts: Spark takes what is parsed out of pages for as small as their file."""
    return rows.hint("merge")


def _per_page(fields: DataFrame, acts: DataFrame, form_idx: int) -> DataFrame:
    """One row per page: its actions, the fields of the form, and how they are linked. Both tables are read once."""
    told = acts.select("page_id", "pos", "id", "type", _blob("label", "placeholder").alias("ablob"))
    by_acts = told.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "type", "ablob"))).alias("acts"))
    kind = F.lower(F.coalesce("type", F.lit("text")))
    own = fields.withColumn("placeholder", F.coalesce(F.col("attrs")["placeholder"], F.lit(""))).withColumn("blob", _blob("label", "name", "placeholder")).withColumn("kind", field_kind())
    own = own.withColumn("submits", kind.isin("submit", "button") & F.col("tag").isin("button", "input")).withColumn("button", F.col("type").isin("submit", "button") | (F.col("tag") == "button"))
    one = F.struct("field_idx", "tag", "type", "name", "label", "placeholder", "required", "blob", "kind", "submits", "button")
    mine = (F.col("form_idx") == form_idx) & F.col("field_idx").isNotNull()
    by_form = own.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(mine, one))).alias("all_fields"))
    rows = by_form.join(by_acts, "page_id", "full_outer").withColumn("formless", F.col("all_fields").isNull())
    linked = rows.withColumn("__l", _link("all_fields", "acts"))
    return linked.withColumn("fields", F.filter("all_fields", lambda f: ~f["submits"])).withColumn("links", F.col("__l.links")).withColumn("submit", F.col("__l.submit")).drop("__l", "all_fields")


def link_fields(fields: DataFrame, acts: DataFrame, *, form_idx: int = 0) -> DataFrame:
    """The fields of one form of each page, but for its submit buttons, with kind, blob, sid and match_score."""
    rows = _per_page(fields, acts, form_idx).filter(~F.col("formless"))
    each = rows.select("page_id", F.explode(F.arrays_zip("fields", "links")).alias("x"))
    return each.select("page_id", F.lit(form_idx).alias("form_idx"), "x.fields.*", "x.links.*").drop("submits", "button")


def page_blockers(acts: Column, page_class: Column) -> Column:
    """What keeps a plan from starting, as an array of (reason, sid): the page's class, then robot checks and other sites' logins among its actions (ablob, id)."""
    none = F.lit(None).cast("string")
    one = lambda code, sid: F.struct(code.alias("reason"), sid.alias("sid"))
    code = F.when(page_class == "Anti-bot", "anti_bot").when(page_class == "Auth-gated", "auth_gated")
    found = F.flatten(F.transform(F.coalesce(acts, F.array().cast("array<struct<pos:int,id:string,type:string,ablob:string>>")), lambda a: F.array(F.when(a["ablob"].rlike(BLOCKER), one(F.lit("captcha"), a["id"])), F.when(a["ablob"].rlike(OAUTH), one(F.lit("oauth"), a["id"])))))
    return F.filter(F.concat(F.array(F.when(code.isNotNull(), one(code, none))), found), lambda x: x.isNotNull())


def profile_value(kind: Column, profile: Column) -> Column:
    """What a profile (a map) says for a kind of field; NULL or '' if nothing."""
    has = lambda k: F.when(F.coalesce(profile[k], F.lit("")) != "", profile[k])
    words = F.filter(F.split(F.trim(F.coalesce(profile["name"], F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    return (
        F.when(kind == "email", has("email"))
        .when(kind == "name", F.coalesce(has("name"), has("full_name")))
        .when(kind == "first_name", F.coalesce(has("first_name"), F.try_element_at(words, F.lit(1))))
        .when(kind == "last_name", F.coalesce(has("last_name"), F.when(F.size(words) > 1, F.try_element_at(words, F.lit(-1)))))
        .when(kind == "company", has("company"))
        .when(kind == "role", F.coalesce(has("role"), has("job_title")))
        .when(kind == "phone", F.coalesce(has("phone"), has("tel")))
    )


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """profiles (profile: map) with valid, unknown_keys and missing_recommended."""
    unknown = F.sort_array(F.filter(F.map_keys("profile"), lambda k: ~k.isin(*KNOWN_KEYS)))
    missing = F.filter(F.array(*map(F.lit, RECOMMENDED_KEYS)), lambda k: F.coalesce(F.try_element_at("profile", k), F.lit("")) == "")
    return profiles.withColumn("unknown_keys", unknown).withColumn("missing_recommended", missing).withColumn("valid", F.size("unknown_keys") == 0)


def invalid_value(kind: Column, value: Column) -> Column:
    """Why a value can't go into a field of that kind; NULL if it can."""
    bad = (kind == "email") & (F.coalesce(value, F.lit("")) != "") & ~F.trim(value).rlike(EMAIL)
    return F.when(bad, F.concat(F.lit("not an email address: "), value))


def plan(fields: DataFrame, acts: DataFrame, classes: DataFrame, profiles: DataFrame, *, form_idx: int = 0, allow_password: bool = False, auto_submit: bool = True) -> DataFrame:
    """The steps for one form of each page of classes (page_id, page_class), in order: auto_fill, ask, handoff, skip, submit.

    Pages with blockers get only handoffs for them; pages without forms one handoff. profiles has page_id and profile (map).
    """
    none = F.lit(None).cast("string")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = classes.join(_never_broadcast(_per_page(fields, acts, form_idx)), "page_id", "left").join(_never_broadcast(profiles.select("page_id", "profile")), "page_id", "left")
    rows = rows.withColumn("blockers", page_blockers(F.col("acts"), F.col("page_class"))).withColumn("profile", F.coalesce("profile", empty))

    def step(place: Column, action: Column | str, reason: Column, sid: Column = none, value: Column = none, kind: Column = none, label: Column = none, question: Column = none) -> Column:
        action = F.lit(action) if isinstance(action, str) else action
        return F.struct(place.cast("long").alias("place"), action.alias("action"), reason.alias("reason"), sid.alias("sid"), value.alias("value"), kind.alias("kind"), label.alias("label"), question.alias("question_id"))

    def of_field(x: Column) -> Column:
        f, sid = x["fields"], x["links"]["sid"]
        kind, needed, value = f["kind"], F.coalesce(f["required"], F.lit(False)), profile_value(f["kind"], F.col("profile"))
        given, safe = F.coalesce(value, F.lit("")) != "", kind.isin(*SAFE)
        handoff = (
            F.when(kind == "file", "file_upload")
            .when(kind.isin("captcha", "oauth"), kind)
            .when(kind == "date", "custom_datepicker")
            .when((kind == "password") & F.lit(not allow_password), "password_requires_handoff")
            .when(needed & sid.isNull(), "missing_binding_invisible_validation")
        )
        label = F.coalesce(F.when(f["label"] != "", f["label"]), f["name"], kind)
        ask = lambda why: step(f["field_idx"], "ask", F.lit(why), sid, none, kind, label, F.format_string("form%d_field%d", F.lit(form_idx), f["field_idx"]))
        return (
            F.when(handoff.isNotNull(), step(f["field_idx"], "handoff", handoff, none, none, kind, label))
            .when(kind == "hidden", step(f["field_idx"], "skip", F.lit("hidden_field"), none, none, kind, label))
            .when(safe & given & sid.isNotNull(), step(f["field_idx"], "auto_fill", F.lit("safe_field"), sid, value, kind, label))
            .when(safe & needed & ~given, ask("missing_profile_value"))
            .when(~safe, ask("ambiguous_field"))
            .when(sid.isNotNull(), ask("unclassified_field"))
        )

    by_field = F.filter(F.transform(F.arrays_zip("fields", "links"), of_field), lambda x: x.isNotNull())
    may_submit = F.lit(auto_submit) & ~F.exists("__steps", lambda x: x["action"] == "handoff") & F.col("submit").isNotNull()
    with_submit = F.when(may_submit, F.concat("__steps", F.array(step(F.lit(10**9), "submit", F.lit("form_submit"), F.col("submit"))))).otherwise(F.col("__steps"))
    steps = (
        F.when(F.size("blockers") > 0, F.transform("blockers", lambda x, i: step(i, "handoff", x["reason"], x["sid"])))
        .when(F.coalesce("formless", F.lit(True)), F.array(step(F.lit(0), "handoff", F.lit("no_forms"))))
        .otherwise(with_submit)
    )
    return rows.withColumn("__steps", by_field).select("page_id", F.explode(steps).alias("s")).select("page_id", "s.*")


def summarize(steps: DataFrame) -> DataFrame:
    """Per page how many steps of each kind."""
    return steps.groupBy("page_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("auto_fill", "ask", "handoff", "skip", "submit")])


def answer(steps: DataFrame, answers: DataFrame) -> DataFrame:
    """steps with questions answered: answers has page_id, question (an id, else a label) and answer."""
    given = answers.filter("coalesce(answer, '') <> ''").groupBy("page_id", "question").agg(F.min("answer").alias("answer"))
    by_id = given.select("page_id", F.col("question").alias("question_id"), F.col("answer").alias("__by_id"))
    by_label = given.select("page_id", F.col("question").alias("label"), F.col("answer").alias("__by_label"))
    rows = steps.join(_never_broadcast(by_id), ["page_id", "question_id"], "left").join(_never_broadcast(by_label), ["page_id", "label"], "left")
    found = F.coalesce("__by_id", "__by_label")
    hit = (F.col("action") == "ask") & found.isNotNull() & F.col("sid").isNotNull()
    return rows.withColumn("value", F.when(hit, found).otherwise(F.col("value"))).withColumn("reason", F.when(hit, "answered").otherwise(F.col("reason"))).withColumn("action", F.when(hit, "auto_fill").otherwise(F.col("action"))).select(*steps.columns)


def validation_errors(filled: DataFrame, invalid: DataFrame) -> DataFrame:
    """Fields that a browser found invalid, with the first filled step that may be theirs: invalid has page_id, pos, name,
    message; filled has page_id, place, sid, name, value. A missing name fits any."""
    rows = invalid.withColumnRenamed("name", "wrong").join(filled, "page_id")
    fits = (F.coalesce("wrong", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "") | (F.col("wrong") == F.col("name"))
    rows = rows.filter(fits).withColumn("__n", F.row_number().over(Window.partitionBy("page_id", "pos").orderBy("place"))).filter("__n = 1")
    return rows.select("page_id", "pos", "sid", "value", F.coalesce(F.when(F.col("message") != "", F.col("message")), F.lit("client validation failed")).alias("message"))


def replay(steps: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per page how a recorded execution of its plan ended: outcomes has page_id, sid, ok. Open questions stop a plan, then
    handoffs; after that a failed step is a validation error."""
    done = steps.join(_never_broadcast(outcomes), ["page_id", "sid"], "left")
    out = done.groupBy("page_id").agg(F.count_if(F.col("action") == "ask").alias("questions"), F.count_if(F.col("action") == "handoff").alias("handoffs"), F.count_if(F.col("action") == "auto_fill").alias("fills"), F.count_if(F.col("action").isin("auto_fill", "submit") & ~F.coalesce("ok", F.lit(True))).alias("failed"))
    return out.withColumn("status", F.when(F.col("questions") > 0, "questions_pending").when(F.col("handoffs") > 0, "handoff").when(F.col("failed") > 0, "validation_error").otherwise("completed"))


def message_errors(filled: DataFrame, appeared: DataFrame) -> DataFrame:
    """Validation messages among the actions that appeared after a submit, with the first filled step that they speak of:
    appeared has page_id, pos, label; filled has page_id, place, sid, value, blob (the folded text of its field)."""
    told = appeared.filter(F.coalesce("label", F.lit("")).rlike(MESSAGE)).withColumn("said", folded(F.col("label")))
    rows = told.select("page_id", "pos", "said", F.col("label").alias("message")).join(filled, "page_id")
    rows = rows.filter((F.col("blob") != "") & (F.contains("said", F.col("blob")) | F.contains("blob", F.col("said"))))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id", "pos").orderBy("place"))).filter("__n = 1")
    return rows.select("page_id", "pos", "sid", "value", "message")


def replay_steps(plans: DataFrame, outcomes: DataFrame, *, most: int = 3) -> DataFrame:
    """Per page how a form of several steps went: plans has step and the columns of a plan, outcomes page_id, step, sid, ok.
    The run goes on while steps are completed, for `most` steps; the last step reached and its status are given."""
    keyed = F.concat_ws("#", "page_id", "step")
    each = replay(plans.filter(F.col("step") <= most).withColumn("page_id", keyed), outcomes.withColumn("page_id", keyed))
    split = each.select(F.substring_index("page_id", "#", 1).cast("long").alias("page_id"), F.substring_index("page_id", "#", -1).cast("int").alias("step"), "status")
    halted = F.min(F.when(F.col("status") != "completed", F.col("step"))).over(Window.partitionBy("page_id"))
    reached = split.withColumn("__h", halted).filter(F.col("__h").isNull() | (F.col("step") <= F.col("__h")))
    return reached.groupBy("page_id").agg(F.max("step").alias("last_step"), F.max_by("status", "step").alias("status"))
