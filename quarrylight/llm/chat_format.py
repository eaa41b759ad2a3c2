r"""Chat formatting of heterogeneous records.

A record is a JSON object. Its *schema fingerprint* is the hash of its sorted nested field paths (list
items share one path), of those that any mapping names; the fingerprint looks its declarative mapping up in a
registry, which holds each mapping under its required paths with every choice of its optional ones. A fingerprint
that is not registered (say, a record that fits two layouts at once) falls back to the first mapping whose required
paths are all there; a record that none fits gets an empty list of turns and ``layout = 'unknown'``. An item of a
list of turns that is no object is a turn without a role.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` per turn. Inside roles and texts ``\`` becomes ``\\`` and
``<|`` becomes ``<\|`` (and a line feed in a role ``\n``), so no text can open or close a turn, and
``unescape`` restores it exactly. The loss mask covers the escaped text of each assistant turn.

Defined cases: null role and text are empty; turns with equal or null numbers are ordered by number
(nulls first), then role, then text; a conversation without turns does not arise from rows; other columns
are ignored. A conversation's turns meet in one row, as its one digest demands.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Declarative layouts: required and optional paths, and how turns are read. ``each``: a list of turns with a role and a
#: text field (``roles`` renames); ``fields``: one turn per named field, skipped where absent or empty.
MAPPINGS = [
    {"layout": "messages", "paths": ["messages", "messages[].role", "messages[].content"], "optional": ["system"], "each": ("messages", "role", "content"), "roles": {}},
    {"layout": "conversations", "paths": ["conversations", "conversations[].from", "conversations[].value"], "optional": ["system"], "each": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    {"layout": "instruction", "paths": ["instruction", "output"], "optional": ["system", "input"], "fields": [("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")]},
    {"layout": "prompt_response", "paths": ["prompt", "response"], "optional": ["system"], "fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
    {"layout": "prompt_completion", "paths": ["prompt", "completion"], "optional": ["system"], "fields": [("system", "system"), ("prompt", "user"), ("completion", "assistant")]},
    {"layout": "question_answer", "paths": ["question", "answer"], "optional": ["context"], "fields": [("context", "system"), ("question", "user"), ("answer", "assistant")]},
]


def field_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in {f"{at}.{k}".lstrip("."), *field_paths(v, f"{at}.{k}".lstrip("."))}}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return set()


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Layouts:
    """The registry of a set of mappings, by fingerprint."""

    def __init__(self, mappings: list[dict] = MAPPINGS):
        self.mappings = mappings
        self.named = {p for m in mappings for p in (*m["paths"], *m["optional"])}
        self.registry: dict[str, dict] = {}
        for m in reversed(mappings):  # of equal fingerprints the first mapping's stays
            for n in range(len(m["optional"]) + 1):
                for some in combinations(m["optional"], n):
                    self.registry[fingerprint({*m["paths"], *some})] = m

    def select(self, record: object) -> dict | None:
        paths = field_paths(record) & self.named
        found = self.registry.get(fingerprint(paths))
        return found or next((m for m in self.mappings if paths >= set(m["paths"])), None)

    def turns(self, record: object) -> tuple[str, list[tuple[str, str]]]:
        m = self.select(record)
        if m is None:
            return "unknown", []
        text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        if "each" in m:
            top, role, content = m["each"]
            items = record[top] if isinstance(record[top], list) else [record[top]]
            turns = [(m["roles"].get(r := text(x.get(role)), r), text(x.get(content))) if isinstance(x, dict) else ("", text(x)) for x in items]
            return m["layout"], [*([("system", text(record["system"]))] if record.get("system") else []), *turns]
        needed = set(m["paths"])
        return m["layout"], [(role, text(record.get(f))) for f, role in m["fields"] if f in needed or record.get(f)]


def escape(text: str, line_feeds: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if line_feeds else out


def unescape(text: str, line_feeds: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if line_feeds and m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans under the loss mask."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role, True)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; the exact inverse of ``render``."""
    return [(unescape(m[1], True), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """conv_id, layout, formatted, mask (array of spans in code points) for JSON records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layouts = Layouts()
        for pdf in batches:
            out = []
            for conv, raw in zip(pdf["conv_id"], pdf["record"], strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                layout, turns = layouts.turns(record)
                formatted, mask = render(turns)
                out.append((conv, layout, formatted, [{"start": a, "stop": b} for a, b in mask]))
            yield pd.DataFrame(out, columns=["conv_id", "layout", "formatted", "mask"]).astype({"conv_id": "Int64"})

    src = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record_col).cast("string").alias("record"))
    return src.mapInPandas(run, "conv_id long, layout string, formatted string, mask array<struct<start: long, stop: long>>")


def records_of_turns(turns: DataFrame) -> DataFrame:
    """conv_id, record: rows (conv_id, turn, role, text) gathered into JSON records. A user and an
    assistant turn alone take the prompt/response layout, everything else the messages layout."""
    one = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    gathered = turns.select("conv_id", one.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    pair = (F.size("m") == 2) & (F.col("m")[0]["role"] == "user") & (F.col("m")[1]["role"] == "assistant")
    as_pair = F.to_json(F.struct(F.col("m")[0]["content"].alias("prompt"), F.col("m")[1]["content"].alias("response")))
    as_list = F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    return gathered.select("conv_id", F.when(pair, as_pair).otherwise(as_list).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and masks say, and nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for pdf in batches:
            out = []
            for conv, layout, text, mask in zip(pdf["conv_id"], pdf["layout"], pdf["formatted"], pdf["mask"], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in mask)
                out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text), layout))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout"]).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string")
