"""Stored replies of a remote word book and messages of the collector, as column functions.  Nothing here uses a network."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def result_code(body: Column) -> Column:
    """The code of a reply under either of its two names; null if there is none or it isn't a number."""
    code = F.coalesce(F.try_to_number(F.get_json_object(body, "$.result_code"), F.lit("999999")), F.try_to_number(F.get_json_object(body, "$.resultCode"), F.lit("999999")))
    return code.cast("int")


def classify_response(status: Column, body: Column) -> Column:
    """ok, auth (401, 403), http (other than 2xx), malformed (not JSON) or api (a code other than 200)."""
    code = result_code(body)
    return (
        F.when(status.isin(401, 403), "auth")
        .when((status < 200) | (status > 299) | status.isNull(), "http")
        .when(F.try_parse_json(body).isNull(), "malformed")
        .when(code.isNull() | (code != 200), "api")
        .otherwise("ok")
    )


def login_state(status: Column, body: Column) -> Column:
    """Of a login check: ok, auth (401, 403 or any code but 200), http or malformed."""
    kind = classify_response(status, body)
    return F.when(kind == "api", "auth").otherwise(kind)


def retriable(status: Column, body: Column) -> Column:
    """Whether another attempt may help: neither refused nor a client's fault by status or code."""
    kind, code = classify_response(status, body), result_code(body)
    client = status.between(400, 499) | F.coalesce(code.between(400, 499), F.lit(False))
    return (kind != "ok") & (kind != "auth") & ~F.coalesce(client, F.lit(False))


def exists_in_book(body: Column) -> Column:
    """Whether a lookup found the word."""
    return F.coalesce(F.json_array_length(F.get_json_object(body, "$.data_body.list")) > 0, F.lit(False))


def listed_words(body: Column) -> Column:
    """The words of one page of the book's list, given as strings or as objects with a word; an empty array if there is no list."""
    listed = F.from_json(body, "struct<data_body:struct<list:array<variant>>>")["data_body"]["list"]
    words = F.transform(listed, lambda v: F.when(_text(v), F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.word", "string")))
    return F.coalesce(F.filter(words, lambda w: w.isNotNull()), F.array().cast("array<string>"))


def definition(body: Column) -> Column:
    return F.get_json_object(body, "$.wordlist[0].interpret")


# The fields of a request that adds a word, besides the word and its definition.
ADD_WORD_FIELDS = (("course", "*"), ("wordidx", "*"), ("infoidx", "100"), ("selection", "*"), ("opcode", "1"))


def add_word_payload(word: Column, info: Column) -> Column:
    """The JSON object of a request that adds a word."""
    return F.to_json(F.struct(word.alias("word"), F.coalesce(info, F.lit("")).alias("info"), *(F.lit(v).alias(k) for k, v in ADD_WORD_FIELDS)))


def remove_words_payload(words: Column) -> Column:
    return F.array_join(words, ",")


# The types of messages and what each must carry.
MESSAGES = {
    "COLLECT_WORDS": "", "WORDS_COLLECTED": "entries", "GET_COUNTS": "", "MARK_PUSHED": "lemmas", "CHECK_LOGIN": "",
    "RETRY_PUSH": "", "GET_PUSH_STATUS": "", "EXPORT_CSV": "", "IMPORT_CSV": "file",
}
_MESSAGE = "struct<type:string,entries:array<struct<lemma:variant,flags:variant>>,csvText:variant,fileName:variant,lemmas:array<variant>>"
_TALLIES = ("total", "processed", "succeeded", "existing", "failed", "pending")
_REPLY = "struct<ok:variant,csv:variant,error:variant,count:variant,loggedIn:variant,phase:variant," + ",".join(f"{t}:variant" for t in _TALLIES) + ">"


def _is(value: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False))


def _text(value: Column) -> Column:
    return _is(value, "^STRING$")


def _number(value: Column) -> Column:
    return _is(value, "^(BIGINT|DECIMAL.*|DOUBLE)$")


def valid_message(body: Column) -> Column:
    """Whether a JSON message has a known type and what that type must carry: entries of string lemmas and numeric flags, string lemmas, or a file's name and text."""
    m = F.from_json(body, _MESSAGE)
    needs = {
        "entries": m["entries"].isNotNull() & F.forall(m["entries"], lambda e: _text(e["lemma"]) & _number(e["flags"])),
        "lemmas": m["lemmas"].isNotNull() & F.forall(m["lemmas"], _text),
        "file": _text(m["csvText"]) & _text(m["fileName"]),
        "": F.lit(True),
    }
    out = F.lit(False)
    for kind, need in MESSAGES.items():
        out = F.when(m["type"] == kind, needs[need]).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _bool(value: Column, is_: bool) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "boolean") == F.lit(is_), F.lit(False)) & _is(value, "^BOOLEAN$")


def _failed(r: Column) -> Column:
    return _bool(r["ok"], False) & _text(r["error"])


def valid_reply(kind: str, body: Column) -> Column:
    """Whether a JSON reply is well formed; kind is export, login or collect."""
    r = F.from_json(body, _REPLY)
    good = {"export": _bool(r["ok"], True) & _text(r["csv"]), "login": _is(r["loggedIn"], "^BOOLEAN$"), "collect": _bool(r["ok"], True) & _number(r["count"])}[kind]
    return F.coalesce(good | _failed(r), F.lit(False))


def _int(value: Column) -> Column:
    return F.try_variant_get(value, "$", "bigint")


def narrowed_counts(body: Column) -> Column:
    """struct(total, pending) of a reply, or null if malformed."""
    r = F.from_json(body, _REPLY)
    return F.when(_number(r["total"]) & _number(r["pending"]), F.struct(_int(r["total"]).alias("total"), _int(r["pending"]).alias("pending")))


def narrowed_login(body: Column) -> Column:
    """Whether a reply says logged in; anything malformed says no."""
    return F.coalesce(_bool(F.from_json(body, _REPLY)["loggedIn"], True), F.lit(False))


def narrowed_export(body: Column) -> Column:
    """struct(ok, csv, error) of a reply; a malformed one has the error export-unavailable."""
    r = F.from_json(body, _REPLY)
    good = F.coalesce(_bool(r["ok"], True) & _text(r["csv"]), F.lit(False))
    error = F.when(_failed(r), F.try_variant_get(r["error"], "$", "string")).otherwise("export-unavailable")
    return F.struct(good.alias("ok"), F.when(good, F.try_variant_get(r["csv"], "$", "string")).alias("csv"), F.when(~good, error).alias("error"))


def narrowed_import(body: Column) -> Column:
    """struct(ok, total, pending, error) of a reply; a malformed one has the error import-unavailable."""
    r, counts = F.from_json(body, _REPLY), narrowed_counts(body)
    error = F.when(_failed(r), F.try_variant_get(r["error"], "$", "string")).otherwise("import-unavailable")
    return F.struct(counts.isNotNull().alias("ok"), counts["total"].alias("total"), counts["pending"].alias("pending"), F.when(counts.isNull(), error).alias("error"))


def narrowed_status(body: Column) -> Column:
    """The phase of a status reply, or null if the phase is unknown or a tally is missing."""
    r = F.from_json(body, _REPLY)
    phase = F.try_variant_get(r["phase"], "$", "string")
    good = _text(r["phase"]) & phase.isin("idle", "running", "paused", "completed")
    for t in _TALLIES:
        good &= _number(r[t])
    return F.when(good, phase)


def auto_push(setting: Column) -> Column:
    """A setting that isn't a boolean counts as true."""
    return F.coalesce(F.when(setting == "true", True).when(setting == "false", False), F.lit(True))
