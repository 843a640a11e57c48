"""The check of a table of texts against a lexicon."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiguard.operators import detect
from lexiguard.operators.classifier import Dense
from lexiguard.operators.detect import Lexicon

#: What is advised for each recommendation, and the notice that goes with every response.
ADVICE = {"revise_recommended": "표현 수정 검토를 권고합니다.", "review_recommended": "내부 검토를 권고합니다.", "monitor": "참고·관찰을 권고합니다.", "none": "권고 사항이 없습니다."}
NOTICE = "본 결과는 리스크 자문 의견이며 사실 판정이 아닙니다. 특정인에 대한 의도 추정·인사 조치의 근거로 사용하지 마십시오. 최종 판단과 책임은 이용 고객에게 있습니다."


#: The status of an answer while no release is loaded.
UNAVAILABLE = 503


class Unavailable(Exception):
    """No release is loaded; the first argument is the answer's status."""

    @property
    def status(self) -> int:
        return self.args[0]


def check_documents(docs: DataFrame, lexicon: Lexicon, stages: dict[str, bool] | None = None, text_col: str = "text", model: Dense | None = None, distances: bool = False) -> DataFrame:
    """docs with m, the scored matches, and overall_recommendation. Stages are on unless switched off; unknown names are ignored.

    docs must have a column text (or text_col, which is read as text) and none
    of the names m, overall_recommendation. Its columns tokens and base_tokens,
    arrays of (s, e, oov) from a tokenizer, are used if there are any: without
    tokens, runs of letters and digits are the tokens; without base_tokens there
    is no edge check. With a model, ambiguous matches have its scores; without,
    a fixed one. With distances, rules of number terms heed their windows and
    severities. No row moves between tasks.
    """
    on = dict.fromkeys(detect.STAGES, True) | (stages or {})
    docs = docs if text_col == "text" else docs.withColumn("text", F.col(text_col))
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return _settled(detect.scan(docs, lexicon, on["skip_char"], on["pattern"]), lexicon, on, model, distances)


def check_partially(docs: DataFrame, lexicon: Lexicon, stages: dict[str, bool] | None = None, seconds: float | None = None, deadline: float | None = None) -> DataFrame:
    """check_documents() for batches that must give what they can: with status and faults for each text, however others fare.

    status: ok; partial, where some pattern of the lexicon could not be used;
    failed, where the text has no answer, its overall_recommendation being null.
    seconds and deadline are those of detect.scan_tolerantly().
    """
    on = dict.fromkeys(detect.STAGES, True) | (stages or {})
    found = detect.scan_tolerantly(docs.withColumn("text", F.coalesce("text", F.lit(""))), lexicon, on["skip_char"], on["pattern"], seconds, deadline)
    failed = F.exists("faults", lambda f: f.startswith(detect.FAILED))
    status = F.when(failed, "failed").when(F.size("faults") > 0, "partial").otherwise("ok")
    # Only patterns that compile reach the later stages.
    checked = _settled(found, detect.usable(lexicon), on, None, False).withColumn("status", status)
    return checked.withColumn("overall_recommendation", F.when(F.col("status") != "failed", F.col("overall_recommendation")))


def _settled(found: DataFrame, lexicon: Lexicon, on: dict[str, bool], model: Dense | None, distances: bool) -> DataFrame:
    """The stages after the scan, and the scores."""
    if on["jamo_boundary"]:
        found = detect.letter_boundary(found)
    if on["morpheme_boundary"]:
        found = detect.token_containment(found) if "tokens" in found.columns else detect.word_containment(found)
        if "base_tokens" in found.columns:
            found = detect.edge_tokens(found)
    if on["safe_context"]:
        found = detect.safe_context(found)
    if on["combination"]:
        found = detect.combination_within(found, lexicon) if distances else detect.combination(found)
    if on["quotation"]:
        found = detect.quotation(found)
    return detect.score(found, model)


def check(docs: DataFrame, lexicon: Lexicon, stages: dict[str, bool] | None = None, id_col: str = "doc_id", model: Dense | None = None, distances: bool = False) -> DataFrame:
    """One row a match, with the document's id."""
    return check_documents(docs, lexicon, stages, model=model, distances=distances).select(id_col, F.explode("m").alias("x")).select(id_col, "x.*")


def advice(rec):  # noqa: ANN001, ANN201
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv)), rec), F.lit(ADVICE["monitor"]))


def responses(checked: DataFrame, lexicon: Lexicon, id_col: str = "doc_id") -> DataFrame:
    """(id, response): each document's answer as JSON with advice and the notice."""
    span = lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))
    names = ("matched_text", "surface", "term_id", "categories", "severity", "ambiguity", "match_confidence", "context_score", "risk_score", "usage_recommendation", "flags")
    one = lambda x: F.struct(span(x).alias("span"), *(x[n].alias(n) for n in names), advice(x.usage_recommendation).alias("advisory"))
    body = F.struct(
        F.lit(lexicon.version).alias("release_version"), "overall_recommendation", advice(F.col("overall_recommendation")).alias("overall_advisory"), F.lit(NOTICE).alias("usage_notice"),
        F.transform("m", one).alias("matches"), F.struct(F.size("m").alias("match_count")).alias("debug"),
    )
    return checked.select(id_col, F.to_json(body).alias("response"))


def check_text(spark, text: str, lexicon: Lexicon | None, stages: dict[str, bool] | None = None, model: Dense | None = None) -> str:  # noqa: ANN001
    """The JSON answer for one text. Without a loaded lexicon there is none, but an error that a service answers with UNAVAILABLE."""
    if lexicon is None:
        raise Unavailable(UNAVAILABLE, "no release loaded")
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return responses(check_documents(docs, lexicon, stages, model=model), lexicon).first()["response"]


class Service:
    """Checks of single texts over HTTP: POST /v1/check/text with {"text": …} answers as check_text() does, and with times by step."""

    def __init__(self, spark, lexicon: Lexicon | None, model: Dense | None = None) -> None:  # noqa: ANN001
        self.spark, self.lexicon, self.model = spark, lexicon, model

    def answer(self, path: str, body: bytes) -> tuple[int, str]:
        if path != "/v1/check/text":
            return 404, '{"detail": "no such path"}'
        try:
            asked = json.loads(body)
            text = asked["text"]
            if not isinstance(text, str):
                raise ValueError(text)
        except (ValueError, KeyError, TypeError):
            return 422, '{"detail": "text is missing"}'
        began = time.perf_counter()
        try:
            out = json.loads(check_text(self.spark, text, self.lexicon, asked.get("stages"), self.model))
        except Unavailable as e:
            return e.status, json.dumps({"detail": e.args[1]})
        out["debug"]["timings_ms"] = {"total": (time.perf_counter() - began) * 1000}
        return 200, json.dumps(out, ensure_ascii=False)

    def serve(self, host: str = "127.0.0.1", port: int = 0) -> HTTPServer:
        """A server for the caller to run; with port 0 it takes a free one."""
        answer = self.answer

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                status, text = answer(self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                raw = text.encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_: object) -> None:
                pass

        return HTTPServer((host, port), Handler)
