"""Conversations of any known layout as canonical turns, and turns as marked training text with a loss mask.

Layouts are told apart by schema fingerprints: the nested field paths of a record, sorted and hashed. A fingerprint
selects a mapping, a declaration of where turns, roles and texts stand, and one reader carries out any mapping.
A fingerprint that no mapping names is taken once more over those fields only that mappings use, so that ids, scores and
the like do not make a layout unknown. Records that are unknown then, or no JSON objects, are errors unless
`unknown="skip"` leaves them to the caller. Null and empty records have no turns.

Each turn becomes OPEN role newline text CLOSE newline. In roles and texts every `<` followed by backslashes, none
or more, and `|` gets one backslash more, so that no text holds a control string and reading takes it away again;
in roles a backslash and a line break are written as two characters as well. The loss mask covers the
text of assistant turns. A conversation's text is the formatted turns in order, and is never gathered in one row: long
conversations stay rows, and reading back streams through them.

Null roles and texts count as empty. Turns of equal number go by role, then text; null numbers come first; a null
conversation is one of its own. Repeated rows are turns of their own. Other columns are ignored. An empty table
gives an empty result, here and when read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def paths(value: object, prefix: str = "") -> set[str]:
    """The nested field paths of a record; [] stands for the elements of a list."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{prefix}.{k}" if prefix else k)} or {prefix}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def fingerprint(fields: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


def _listed(at: str, role: str, text: str) -> dict:
    return {"list": at, "role": role, "text": text}


def _named(*turns: tuple[str, ...]) -> dict:
    return {"turns": turns}


#: Layouts by their field paths. A mapping names a list with the fields of its elements, or turns as a role
#: and the fields whose texts, joined by blank lines, it says; empty fields are left out.
LAYOUTS = (
    (("role", "text"), _named(("=role", "text"))),
    (("role", "content"), _named(("=role", "content"))),
    (("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    (("messages[]",), _listed("messages", "role", "content")),
    (("id", "messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    (("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    (("id", "conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    (("prompt", "response"), _named(("user", "prompt"), (LEARNED, "response"))),
    (("prompt", "completion"), _named(("user", "prompt"), (LEARNED, "completion"))),
    (("system", "prompt", "response"), _named(("system", "system"), ("user", "prompt"), (LEARNED, "response"))),
    (("question", "answer"), _named(("user", "question"), (LEARNED, "answer"))),
    (("instruction", "output"), _named(("user", "instruction"), (LEARNED, "output"))),
    (("instruction", "input", "output"), _named(("user", "instruction", "input"), (LEARNED, "output"))),
    (("system", "instruction", "input", "output"), _named(("system", "system"), ("user", "instruction", "input"), (LEARNED, "output"))),
)
MAPPINGS = {fingerprint(fields): mapping for fields, mapping in LAYOUTS}
#: Names that layouts give to the roles of the canonical form.
ROLES = {"human": "user", "gpt": LEARNED, "bot": LEARNED, "model": LEARNED}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: dict) -> list[tuple[str, str]]:
    if "list" in mapping:
        said = [(_text(m.get(mapping["role"])), _text(m.get(mapping["text"]))) for m in record[mapping["list"]] or []]
        return [(ROLES.get(role, role), text) for role, text in said]
    out = []
    for role, *fields in mapping["turns"]:
        if role[0] == "=":
            out.append((_text(record[role[1:]]), _text(record[fields[0]])))
        elif text := "\n\n".join(t for f in fields if (t := _text(record.get(f)))):
            out.append((role, text))
    return out


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fields_of(mapping: dict) -> set[str]:
    """The field paths that a mapping uses."""
    if "list" in mapping:
        return {f"{mapping['list']}[]", *(f"{mapping['list']}[].{mapping[k]}" for k in ("role", "text"))}
    return {field.removeprefix("=") for turn in mapping["turns"] for field in (turn[1:] if turn[0][0] != "=" else turn)}


def mapping_of(record: dict, mappings: dict, used: set[str]) -> dict | None:
    fields = paths(record)
    return mappings.get(fingerprint(fields)) or mappings.get(fingerprint(fields & used))


def _object(raw: str) -> object:
    try:
        return json.loads(raw)
    except ValueError:
        return raw


def _canonical(mappings: dict, unknown: str):
    used = set().union(*map(fields_of, mappings.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part, roles, texts = [], [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                record = _object(raw) if raw else {}
                mapping = mapping_of(record, mappings, used) if isinstance(record, dict) else None
                if mapping is None:
                    if record and unknown != "skip":
                        raise ValueError(f"no mapping for fingerprint {fingerprint(paths(record))} of fields {sorted(paths(record))}")
                    continue
                for k, (role, text) in enumerate(turns_of(record, mapping)):
                    at.append(i)
                    part.append(k)
                    roles.append(role)
                    texts.append(text)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), pa.array(roles, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["carried", "part", "role", "text"])

    return run


def canonical_turns(records: DataFrame, record: str, carry: tuple[str, ...], *, mappings: dict | None = None, unknown: str = "error") -> DataFrame:
    """The carried columns, part, role and text: a row for each turn of the JSON records, `part` counting within one."""
    rows = records.select(F.struct(*[F.col(c) for c in carry]).alias("carried"), F.col(record).alias("record"))
    kind = rows.schema["carried"].dataType.simpleString()
    out = rows.mapInArrow(_canonical(mappings or MAPPINGS, unknown), f"carried {kind}, part int, role string, text string")
    return out.select(*[F.col("carried")[c].alias(c) for c in carry], "part", "role", "text")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, starts, stops = [], [], []
        for role, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            head = f"{OPEN}{_escape_role(role or '')}\n"
            body = escape(text or "")
            learned = role == LEARNED
            texts.append(f"{head}{body}{CLOSE}\n")
            starts.append(len(head) if learned else 0)
            stops.append(len(head) + len(body) if learned else 0)
        columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["carried", "formatted", "loss_start", "loss_stop"])


def format_turns(turns: DataFrame, order: tuple[str, ...] = ("turn", "part"), *, conversation: str = "conv_id") -> DataFrame:
    """conversation, its order columns, formatted, loss_start and loss_stop: one row per turn, the mask in code points.

    `read_back` puts turns of equal numbers in the order of their formatted text, which is by role, then text.
    """
    carried = F.struct(F.col(conversation).alias("conversation"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = turns.select(carried.alias("carried"), "role", "text")
    kind = rows.schema["carried"].dataType.simpleString()
    out = rows.mapInArrow(_formatted, f"carried {kind}, formatted string, loss_start long, loss_stop long")
    return out.select("carried.*", "formatted", "loss_start", "loss_stop")


class _Read:
    """What has been read of one conversation."""

    def __init__(self, conversation) -> None:
        self.conversation, self.turns, self.chars, self.learned = conversation, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, stop: int) -> None:
        self.chars += len(formatted)
        for role, text in TURN.findall(formatted):
            self.turns += 1
            self.all.update(f"{_unescape_role(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
        under = unescape(formatted[start:stop])
        self.learned += len(under)
        self.loss.update(under.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conversation, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        out = []
        for conversation, formatted, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is None or at.conversation != conversation:
                if at is not None:
                    out.append(at.row())
                at = _Read(conversation)
            at.add(formatted, start, stop)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), READ, strict=True)], schema=READ)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(at.row(), READ, strict=True)], schema=READ)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, read from the formatted text and its mask: counts and digests of all turns and of the learned text.

    Turns of a conversation come sorted to one task and are streamed through, so that memory does not grow with it.
    """
    order = [c for c in formatted.columns if re.fullmatch(r"o\d+", c)]
    rows = formatted.repartition("conversation").sortWithinPartitions("conversation", *order, "formatted")
    rows = rows.select(F.col("conversation").cast("long"), "formatted", "loss_start", "loss_stop")
    return rows.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted turns of a table that has a row per turn."""
    record = F.to_json(F.struct(F.col(role).alias("role"), F.col(text).alias("text")), {"ignoreNullFields": "false"})
    records = rows.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), record.alias("record"))
    return format_turns(canonical_turns(records, "record", ("conv_id", "turn")))
