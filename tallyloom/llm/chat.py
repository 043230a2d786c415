"""Chat formatting: a fingerprint of the field paths selects the mapping to canonical turns.

A record is JSON of any layout. Its nested field paths (`messages[].role`), but for those of descriptive fields (`DESCRIPTIVE`), are hashed; the hash selects a declarative
mapping, and a record whose paths no mapping knows is reported with its fingerprint and no turns, also in what is formatted. Canonical turns are
written with turn marks; control strings inside texts are escaped reversibly, and the loss mask lists the code-point ranges of assistant
texts.

Escaping: in `<`, any number of backslashes, `|`, one more backslash is put in; so no text holds `<|`, and taking one out restores it.
Roles also have backslash and line feed escaped.

Edge cases: null texts and roles count as empty; turns sort by turn, role and text, nulls first, and repeated rows are each a turn; an empty table gives no rows;
rows with a null conversation id form one conversation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import bounded_batches

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a JSON value, with the kind of each leaf; all elements of a list share one path."""
    if isinstance(value, dict):
        return set(chain.from_iterable(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) or {f"{at}{{}}"}
    if isinstance(value, list):
        return set(chain.from_iterable(paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


#: Fields that describe a record or a turn and are no part of what is said. Fixed values.
DESCRIPTIVE = frozenset("id uid source lang language created created_at timestamp date model tags tag category meta metadata score rating license split index weight name".split())


def fingerprint(found: set[str]) -> str:
    """The hash of the paths without those that have a descriptive field in them."""
    said = {p for p in found if not DESCRIPTIVE.intersection(p.replace("[]", "").replace("{}", "").split("."))}
    return xxhash.xxh3_64_hexdigest("\n".join(sorted(said)))


def said(value: object) -> str:
    """A leaf as text: null is empty, what is not a string is written as JSON."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


@dataclass(frozen=True)
class Mapping:
    """Fields in order, each with its role (neighbours of one role are one turn), or a list: its elements name a role and a text, or
    are texts of alternating roles. A list may lie deeper (`data.messages`)."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    alternating: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.each:
            listed = record
            for step in self.each.split("."):
                listed = listed[step]
            if self.alternating:
                return [(self.alternating[i % len(self.alternating)], said(x)) for i, x in enumerate(listed)]
            return [(self.roles.get(said(x.get(self.role)), said(x.get(self.role))), said(x.get(self.text))) for x in listed]
        out: list[tuple[str, str]] = []
        for f, role in self.fields:
            if f not in record or (f in self.optional and not record[f]):
                continue
            text = said(record[f])
            out[-1:] = [(role, f"{out[-1][1]}\n\n{text}")] if out and out[-1][0] == role else [*out[-1:], (role, text)]
        return out

    def fingerprints(self) -> list[str]:
        if self.each:
            element = {f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"}
            options = [{f"{self.each}[]"}] if self.alternating else [element, {f"{self.each}[]"}]
        else:
            always = {f for f, _ in self.fields} - set(self.optional)
            options = [always | set(c) for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [fingerprint(o) for o in options]


_SHARED = {"human": "user", "gpt": "assistant"}
MAPPINGS = (
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("shared", each="conversations", role="from", text="value", roles=_SHARED),
    Mapping("prompt and response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("prompt and completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question and answer", fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Mapping("query and reply", fields=(("query", "user"), ("reply", "assistant"))),
    Mapping("dialog", each="dialog", alternating=("user", "assistant")),
    Mapping("nested messages", each="data.messages", role="role", text="content"),
    Mapping("speakers", each="turns", role="speaker", text="utterance", roles={"customer": "user", "agent": "assistant", "bot": "assistant"}),
)
BY_FINGERPRINT = {f: m for m in MAPPINGS for f in m.fingerprints()}


def canonical(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """key, fingerprint, layout and turns of JSON records; layout and turns are null where no mapping knows the paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[record], strict=True):
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    rows.append((k, None, None, None))
                    continue
                f = fingerprint(paths(value))
                m = BY_FINGERPRINT.get(f)
                rows.append((k, f, m and m.name, m and [{"role": r, "text": t} for r, t in m.turns(value)]))
            yield pd.DataFrame(rows, columns=[key, "fingerprint", "layout", "turns"]).astype({key: "Int64"})

    return records.select(key, record).mapInPandas(run, f"{key} long, fingerprint string, layout string, turns {TURNS}")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def write(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code-point ranges under the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest.removesuffix("\n").removesuffix(END))))
    return out


def formatted(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted, loss_mask array<struct<start, end>>, rejected; a record without turns stays, rejected and without a text."""
    bounded_batches(turns.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [(None, None) if turns is None else write([(t["role"], t["text"]) for t in turns]) for turns in b["turns"]]
            mask = [m if m is None else [{"start": s, "end": e} for s, e in m] for _, m in done]
            yield pd.DataFrame({key: b[key].astype("Int64"), "formatted": [d[0] for d in done], "loss_mask": mask, "rejected": [d[0] is None for d in done]})

    return turns.select(key, "turns").mapInPandas(run, f"{key} long, formatted string, loss_mask array<struct<start:long,end:long>>, rejected boolean")


def read_back(done: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns and loss_text of what was formatted, from the formatted text and the mask alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turns = [[{"role": r, "text": t} for r, t in read(f)] for f in b["formatted"]]
            loss = ["".join(unescape(f[m["start"] : m["end"]]) for m in mask) for f, mask in zip(b["formatted"], b["loss_mask"], strict=True)]
            yield pd.DataFrame({key: b[key].astype("Int64"), "turns": turns, "loss_text": loss, "formatted_chars": [len(f) for f in b["formatted"]]})

    told = done.where("not rejected").select(key, "formatted", "loss_mask")
    return told.mapInPandas(run, f"{key} long, turns {TURNS}, loss_text string, formatted_chars long")


def records(conversations: DataFrame) -> DataFrame:
    """Rows of turns as one JSON record for each conversation, in the layout that its roles allow."""
    text = lambda c: F.coalesce(c, F.lit(""))
    turn = F.struct("turn", text(F.col("role")).alias("role"), text(F.col("text")).alias("text"))
    by = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), "|")
    nth = lambda i: F.get(F.col("t"), F.lit(i))["text"]
    plain = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    third = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    shared = lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value"))

    def as_json(*columns: Column) -> Column:
        return F.to_json(F.struct(*columns))

    record = (
        F.when((roles == "user|assistant") & (third == 0), as_json(nth(0).alias("prompt"), nth(1).alias("response")))
        .when((roles == "user|assistant") & (third == 1), as_json(nth(0).alias("instruction"), nth(1).alias("output")))
        .when((roles == "system|user|assistant") & (third == 0), as_json(nth(0).alias("system"), nth(1).alias("prompt"), nth(2).alias("response")))
        .when(plain & (third == 2), as_json(F.transform("t", shared).alias("conversations")))
        .otherwise(as_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    )
    return by.select("conv_id", record.alias("record"))
