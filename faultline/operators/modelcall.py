"""Model calls as one operator: a request column, a table of responses, and a caller for what it lacks.

Responses are keyed by a hash of stage, prompt and image, so every result can be repeated without a model: *replay* is a
join. *Live* calls run in batches on the rows without a response and are written before anything uses them, so that a
task which Spark runs again never changes a result. A failed call is a row with an error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions.seeded import u
from faultline.sources.shared import materialize, new_path

RESPONSES = "request_key string, response string, error string, prompt_tokens long, completion_tokens long"

#: Call points with the parser of their response (a Column of the response, by output column).
STAGES: dict[str, dict[str, Callable[[Column], Column]]] = {
    "completion": {"completed_claim": lambda r: T.json_get(T.json_text(r), "completed_claim"), "is_related": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_related"), F.lit(True))},
    "prediction": {"prediction": lambda r: F.coalesce(T.json_get(T.json_text(r), "prediction"), F.trim(r))},
    "prefill": {"is_relevant": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_relevant"), F.lit(None).cast("boolean")), "values": lambda r: F.from_json(T.json_get(T.json_text(r), "values"), "map<string,string>")},
    "answerable": {"answerable": lambda r: T.parse_bool(T.json_get(T.json_text(r), "answerable"), F.lit(True))},
    "verification": {"judge_correct": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_correct"), F.lit(None).cast("boolean")), "judge_reason": lambda r: T.json_get(T.json_text(r), "failure_reason")},
    "factor_score": {"required_met": lambda r: T.parse_bool(T.json_get(T.json_text(r), "required_met")), "optional_met": lambda r: T.parse_float(T.json_get(T.json_text(r), "optional_met"))},
    "slot": {"value": T.slot_value},
    "question": {"question": T.clean_question},
    "question_check": {"valid": T.verdict_valid, "reason": T.verdict_reason},
    "answer": {"answer": T.parse_answer, "options": T.parse_options},
    "answer_check": {"is_correct": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_correct")), "confidence": lambda r: T.parse_float(T.json_get(T.json_text(r), "confidence"), 0.0), "issues": lambda r: T.parse_issues(T.json_get(T.json_text(r), "issues"))},
    "confidence": {
        "is_correct": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_correct")), "confidence": lambda r: T.parse_float(T.json_get(T.json_text(r), "confidence"), 0.5),
        "passed": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_correct")) & (T.parse_float(T.json_get(T.json_text(r), "confidence"), 0.5) >= 0.7),
        "alternative_options": lambda r: F.coalesce(F.from_json(T.json_get(T.json_text(r), "alternative_options"), "array<string>"), F.array().cast("array<string>")),
    },
    "validation": {
        "is_valid": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_valid")), "validation_reason": lambda r: F.coalesce(T.json_get(T.json_text(r), "validation_reason"), F.lit("")),
        "issues": lambda r: T.parse_issues(T.json_get(T.json_text(r), "issues")),
    },
    "repair": {
        "action": lambda r: F.upper(F.coalesce(T.json_get(T.json_text(r), "action"), F.lit(""))), "new_answer": lambda r: F.trim(F.coalesce(T.json_get(T.json_text(r), "new_answer"), F.lit(""))),
        "repair_reason": lambda r: F.trim(F.coalesce(T.json_get(T.json_text(r), "reason"), F.lit(""))),
    },
    "clarity": {
        "clarity_score": lambda r: T.parse_float(T.json_get(T.json_text(r), "clarity_score"), 0.5), "is_clear": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_clear")),
        "passed": lambda r: T.parse_bool(T.json_get(T.json_text(r), "is_clear")) & (T.parse_float(T.json_get(T.json_text(r), "clarity_score"), 0.5) >= 0.7),
        "ambiguity_level": lambda r: F.coalesce(T.json_get(T.json_text(r), "ambiguity_level"), F.when(F.coalesce(T.json_text(r), F.lit("")) == "", "unknown").otherwise("medium")), "issues": lambda r: T.parse_issues(T.json_get(T.json_text(r), "issues")),
    },
    "image_filter": {"passed": lambda r: T.parse_bool(T.json_get(T.json_text(r), "passed")), "basic_score": lambda r: T.parse_float(T.json_get(T.json_text(r), "basic_score")), "bonus_score": lambda r: T.parse_float(T.json_get(T.json_text(r), "bonus_score")), "confidence": lambda r: T.parse_float(T.json_get(T.json_text(r), "confidence"), 0.5), "reason": lambda r: T.json_get(T.json_text(r), "reason")},
}


def _said(*parts: str | Column) -> Column:
    """Texts and columns one after the other; a null column is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _listed(c: Column) -> Column:
    return F.array_join(c, ", ")


def _options(options: Column) -> Column:
    """Options (a map by letter) as lines in order of the letters; empty without any."""
    lines = F.transform(F.array_sort(F.map_keys(options)), lambda k: F.concat(F.lit("\n"), k, F.lit(": "), F.element_at(options, k)))
    return F.array_join(lines, "")


def _named_option(options: Column, answer: Column) -> Column:
    """An answer with the text of its option."""
    text = F.try_element_at(options, F.upper(answer))
    return F.when(text.isNotNull(), F.concat(answer, F.lit(" ("), text, F.lit(")"))).otherwise(answer)


#: The prompt of each call point, of columns by name.
PROMPTS: dict[str, Callable[..., Column]] = {
    "completion": lambda template, slots: _said("Look at the image and fill each slot of this claim.\nClaim: ", template, "\nSlots: ", _listed(slots), '\nAnswer with JSON: {"completed_claim": text, "is_related": true or false}.'),
    "prediction": lambda claim: _said("Is this claim about the image true?\nClaim: ", claim, '\nAnswer with JSON: {"prediction": "true" or "false"}.'),
    "prefill": lambda claim, slots: _said("Name a value that the image shows for each slot, if the claim suits the image.\nClaim: ", claim, "\nSlots: ", _listed(slots), '\nAnswer with JSON: {"is_relevant": true or false, "values": {slot: value}}.'),
    "answerable": lambda claim: _said("Can the image settle this claim?\nClaim: ", claim, '\nAnswer with JSON: {"answerable": true or false}.'),
    "verification": lambda claim, answer: _said("Check the answer to a claim against the image.\nClaim: ", claim, "\nAnswer: ", answer, '\nAnswer with JSON: {"is_correct": true or false, "failure_reason": reason or null}.'),
    "factor_score": lambda required, optional: _said("Does the image meet these criteria?\nRequired: ", _listed(required), "\nOptional: ", _listed(optional), '\nAnswer with JSON: {"required_met": true or false, "optional_met": number}.'),
    "slot": lambda slot, about: _said("Give a value for the slot ", slot, " of a question about: ", about, '\nAnswer with JSON: {"value": text}.'),
    "question": lambda intent, slots, why: _said("Write one question. Intent: ", intent, "\nUse: ", _listed(slots), F.when(why.isNotNull(), _said("\nThe last one was refused: ", why))),
    "question_check": lambda question: _said("Is this question clear, and can the image answer it?\nQuestion: ", question, "\nAnswer with two lines, valid: yes or no, and reason: text."),
    "answer": lambda question, n_wrong: _said("Answer the question by the image", F.when(n_wrong > 0, _said(", and give ", n_wrong, " wrong options")), ".\nQuestion: ", question, '\nAnswer with JSON: {"answer": text}, options as a JSON list.'),
    "answer_check": lambda question, answer: _said("Is the answer right, and how sure is that?\nQuestion: ", question, "\nAnswer: ", answer, '\nAnswer with JSON: {"is_correct": true or false, "confidence": number, "issues": [text]}.'),
    "confidence": lambda question, options, answer: _said("How sure is this answer, seen against the image?\nQuestion: ", question, _options(options), "\nAnswer: ", answer, '\nAnswer with JSON: {"is_correct": true or false, "confidence": 0 to 1, "correctness_reason": text, "alternative_options": [letters that would do as well]}.'),
    "validation": lambda question, options, answer: _said("Does this answer agree with the image and with its question?\nQuestion: ", question, _options(options), "\nAnswer: ", _named_option(options, answer), '\nAnswer with JSON: {"is_valid": true or false, "validation_reason": text, "issues": [text]}.'),
    "repair": lambda question, options, answer: _said("Keep the answer if it is clearly right; else give a better one", F.when(F.size(options) > 0, ", by the letter of an option").otherwise(" of one to five words"), ".\nQuestion: ", question, _options(options), "\nAnswer: ", answer, '\nAnswer with JSON: {"action": "KEEP" or "CHANGE", "new_answer": text or null, "reason": text}.'),
    "clarity": lambda question, answer, question_type: _said("Is this question clear, and is there one reading of it only?\nQuestion (", question_type, "): ", question, "\nAnswer: ", answer, '\nAnswer with JSON: {"clarity_score": 0 to 1, "ambiguity_level": "low", "medium" or "high", "is_clear": true or false, "issues": [text]}.'),
    "image_filter": lambda criteria: _said("Does the image meet these criteria?\n", F.array_join(criteria, "\n"), '\nAnswer with JSON: {"passed": true or false, "basic_score": number, "bonus_score": number, "confidence": number, "reason": text}.'),
}


def asked(rows: DataFrame, stage: str, image_id: str | Column, **columns: str | Column) -> DataFrame:
    """Adds the prompt of a call point and its request key. columns: by the names that the prompt takes."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = rows.withColumn("prompt", PROMPTS[stage](**{k: col(v) for k, v in columns.items()}))
    return out.withColumn("request_key", request_key(stage, F.col("prompt"), col(image_id)))


def request_key(stage: str, prompt: Column, image_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(stage), prompt, image_id.cast("string")), 256)


def replay(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (request_key, ...) with response, error and tokens; null where there is no response."""
    tokens = F.coalesce(F.col("prompt_tokens") + F.col("completion_tokens"), F.lit(0))
    return requests.join(responses, "request_key", "left").withColumn("tokens_used", tokens)


def _calls(caller: Callable[[list[str]], list[str]], batch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Requests to responses by batches. If a batch fails, its rows are tried one by one, and a row that fails is data."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return list(caller([prompt]))[0], None
        except Exception as e:
            return None, str(e)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                prompts = part["prompt"].tolist()
                try:
                    answers = [(x, None) for x in caller(prompts)]
                    if len(answers) != len(prompts):
                        raise ValueError(f"{len(answers)} responses to {len(prompts)} prompts")
                except Exception:
                    answers = [one(p) for p in prompts]
                yield pd.DataFrame({"request_key": part["request_key"], "response": [x for x, _ in answers], "error": [e for _, e in answers], "prompt_tokens": 0, "completion_tokens": 0})

    return call


def ledger_responses(spark: SparkSession, ledger: str) -> DataFrame:
    """The responses of a ledger, one for each key: one without an error, if there is one."""
    spark.createDataFrame([], RESPONSES).write.mode("append").parquet(ledger)
    rows = spark.read.schema(RESPONSES).parquet(ledger)
    rest = F.struct(*[x.split()[0] for x in RESPONSES.split(", ")[1:]])
    return rows.groupBy("request_key").agg(F.min_by(rest, F.struct(F.col("error").isNotNull(), "response")).alias("r")).select("request_key", "r.*")


def call_into(requests: DataFrame, caller: Callable[[list[str]], list[str]], ledger: str, batch: int = 16, unit: int = 10_000) -> DataFrame:
    """M0: calls for the keys that a ledger has no response to, and the ledger's responses.

    Requests are dealt by a hash of their keys into units of about so many. A unit is one job that appends its responses
    when it is done, so whatever ends the run, later runs call only for the units that are left, and a lost executor
    repeats its own part of one unit at most. Keys that failed are called again by the next run.
    """
    spark = requests.sparkSession
    done = ledger_responses(spark, ledger).where("error is null").select("request_key")
    todo = requests.select("request_key", "prompt").where("request_key is not null").dropDuplicates(["request_key"]).join(done, "request_key", "left_anti")
    todo = materialize(todo, "requests")
    units = -(-todo.count() // unit)
    if units > 1:
        path = new_path(spark, "units")
        todo.withColumn("unit", F.pmod(F.xxhash64("request_key"), F.lit(units))).repartition("unit").write.partitionBy("unit").parquet(path)
        todo = spark.read.schema("request_key string, prompt string, unit long").parquet(path)
    for n in range(units):
        part = todo.where(F.col("unit") == n) if units > 1 else todo  # a folder of its own
        part = part.select("request_key", "prompt").repartition(spark.sparkContext.defaultParallelism)
        part.mapInPandas(_calls(caller, batch), RESPONSES).write.mode("append").parquet(ledger)
    return ledger_responses(spark, ledger)


def model_call(requests: DataFrame, caller: Callable[[list[str]], list[str]] | None = None, responses: DataFrame | None = None, batch: int = 16, ledger: str | None = None) -> DataFrame:
    """M0: one row out for each row in. requests: request_key, prompt, ...; caller: prompts -> texts, may raise.

    With a ledger (a folder) responses outlive the run, see ``call_into``.
    """
    spark = requests.sparkSession
    known = responses if responses is not None else spark.createDataFrame([], RESPONSES)
    if caller is None:
        return replay(requests, known)
    todo = requests.select("request_key", "prompt").join(known.select("request_key"), "request_key", "left_anti").dropDuplicates(["request_key"])
    if ledger:
        found = call_into(todo, caller, ledger, batch)
        new = materialize(found.join(todo.select("request_key"), "request_key", "left_semi"), "responses")
    else:
        new = materialize(todo.mapInPandas(_calls(caller, batch), RESPONSES), "responses")
    return replay(requests, known.unionByName(new))


def parsed(called: DataFrame, stage: str) -> DataFrame:
    """Adds the columns that a stage reads from its response."""
    return called.withColumns({name: parse(F.col("response")) for name, parse in STAGES[stage].items()})


def regenerate(rows: DataFrame, stage: str, prompt: Callable[[int], Column], check: Column, caller=None, responses: DataFrame | None = None, retries: int = 3, ledger: str | None = None) -> DataFrame:
    """Rounds of call and check on the rows that still fail, each written; all rounds are kept.

    rows: key, image_id, ...; prompt(round) may use ``last`` (the round before's response) and ``why``. The result has
    round, accepted and temperature; a row's last round is its result. With a ledger a run that is repeated asks only for
    what it lacks, since a round's prompts follow from the responses before.
    """
    now, done = rows.withColumn("last", F.lit(None).cast("string")), None
    for n in range(retries + 1):
        asked = now.withColumn("prompt", prompt(n)).withColumn("request_key", request_key(stage, F.col("prompt"), F.col("image_id")))
        out = parsed(model_call(asked, caller, responses, ledger=ledger), stage)
        temperature = 0.0 if n == 0 else 0.5 + min(0.2 * n, 0.2)
        out = materialize(out.withColumn("accepted", F.coalesce(check, F.lit(False))).withColumn("round", F.lit(n)).withColumn("temperature", F.lit(temperature)), "round")
        done = out if done is None else done.unionByName(out)
        now = out.where(~F.col("accepted")).select(*rows.columns, F.col("response").alias("last"))
        if now.isEmpty():
            break
    return done


def call_log(calls: DataFrame) -> DataFrame:
    """Prompts cut at 8,000 and responses at 4,000 characters, with both lengths."""
    return calls.select("request_key", "stage", F.left("prompt", F.lit(8000)).alias("prompt"), F.length("prompt").alias("prompt_length"), F.left("response", F.lit(4000)).alias("response"), F.length("response").alias("response_length"), "error")


def embed(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Id, text -> id, v by a batch encoder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "v": list(encoder(f["text"].tolist()))})

    return texts.select("id", "text").mapInPandas(run, "id long, v array<double>")


def hashed_encoder(n: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in encoder: signed hashed words, normalized."""

    def encode(texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for t in texts:
            v = [0.0] * n
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % n] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return encode


def mock_score(key: Column) -> Column:
    """A stand-in score in (0, 1) for dry runs."""
    return u("mock", key)
