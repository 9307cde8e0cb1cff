"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Each prefix of a
conversation is rendered and compared with the one before: a template that
only appends makes the earlier output a prefix of the later one, and what was
added is the new turn's span. Inside that span the text is found by rendering
the same prefix with a probe in the text's place. A template whose later
output changes earlier output is reported as one that rewrites history, and
no spans are given, as none would hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import mapped

Turns = list[tuple[str, str]]
#: A private-use character that stands for a text while its place is sought.
PROBE = "\ue000"


class MarkedTemplate:
    """Turns as `<s>[INST] role` / text / `[/INST]</s>` lines.

    Control strings inside texts are broken by a backslash after their first
    character, and backslashes are doubled, so escaping can be undone. Roles
    are percent-encoded.
    """

    # The control strings.
    CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
    _FIND = re.compile("|".join(map(re.escape, CONTROLS)))
    _TURN = re.compile(r"<s>\[INST\] ([^\n]*)\n(.*?)\n\[/INST\]</s>\n", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._FIND.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def __call__(self, turns: Turns) -> str:
        return "".join(f"<s>[INST] {quote(role, safe='')}\n{self.escape(text)}\n[/INST]</s>\n" for role, text in turns)

    def parse(self, formatted: str) -> Turns:
        """The turns of a rendered conversation."""
        out, at = [], 0
        for m in self._TURN.finditer(formatted):
            if m.start() != at:
                raise ValueError(f"no turn at {at}")
            out.append((unquote(m[1]), self.unescape(m[2])))
            at = m.end()
        if at != len(formatted):
            raise ValueError(f"no turn at {at}")
        return out


@dataclass(frozen=True)
class Rendered:
    """A rendered conversation; spans are (start, end, text start, text end)."""

    text: str
    spans: list[tuple[int, int, int, int]]
    rewrites_history: bool


def render(template: Callable[[Turns], str], turns: Turns) -> Rendered:
    """Render all prefixes and locate each turn and its text."""
    earlier, spans = template([]), []
    for k, (role, _) in enumerate(turns):
        later = template(turns[: k + 1])
        probed = template([*turns[:k], (role, PROBE)])
        at = probed.find(PROBE, len(earlier))
        # The probe has to be the only difference.
        tail = len(probed) - at - len(PROBE)
        if not later.startswith(earlier) or at < 0 or later[:at] != probed[:at] or len(later) < at + tail or later[len(later) - tail :] != probed[at + len(PROBE) :]:
            return Rendered(template(turns), [], True)
        spans.append((len(earlier), len(later), at, len(later) - tail))
        earlier = later
    return Rendered(earlier, spans, False)


_SPAN = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32())])
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def format_conversations(conversations: DataFrame, template: Callable[[Turns], str] | None = None, learned: tuple[str, ...] = ("assistant",), key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, formatted, spans, loss_mask, rewrites_history) of each conversation.

    spans: for each turn its role and its start and end in `formatted`, and
    those of its text, in code points with the end excluded. loss_mask: the
    spans of the texts of the `learned` roles. Rows are ordered by turn, then
    role and text; null turns come first, a null role or text is empty,
    repeated rows are turns of their own, and rows with a null key form one
    conversation. Other columns aren't read; an empty table gives no rows. A
    conversation is one string, so its rows meet in one task, and rendering
    its prefixes takes time that grows with the square of its turns.
    """
    template = template or MarkedTemplate()
    rows = conversations.select(
        F.col(key).alias("key"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("row"),
    )
    kind = rows.schema["key"].dataType
    whole = rows.groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("key", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, spans, masks, odd = [], [], [], []
                for rows in part.column("turns").to_pylist():
                    turns = [(r["role"], r["text"]) for r in rows]
                    done = render(template, turns)
                    named = [(r, *s) for (r, _), s in zip(turns, done.spans, strict=False)]
                    texts.append(done.text)
                    spans.append([dict(zip(("role", "start", "end", "text_start", "text_end"), s, strict=True)) for s in named])
                    masks.append([{"start": s[3], "end": s[4]} for s in named if s[0] in learned])
                    odd.append(done.rewrites_history)
                mask = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(masks, mask), pa.array(odd, pa.bool_())], ["key", "formatted", "spans", "loss_mask", "rewrites_history"])

    spans = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"
    out = mapped(whole, run, f"key {kind.simpleString()}, formatted string, spans {spans}, loss_mask array<struct<start:int,end:int>>, rewrites_history boolean")
    return out.withColumnRenamed("key", key)


def read_back(formatted: DataFrame, template: MarkedTemplate | None = None, key: str = "conv_id") -> DataFrame:
    """(key, turns array<struct<role, text>>, loss_text) from formatted strings.

    loss_text is what stands under the loss mask, unescaped, with nothing
    between. A string that the template can't have made is an error.
    """
    template = template or MarkedTemplate()
    source = formatted.select(F.col(key).alias("key"), "formatted", "loss_mask")
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses = [], []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                turns.append([{"role": r, "text": t} for r, t in template.parse(text)])
                losses.append("".join(template.unescape(text[m["start"] : m["end"]]) for m in mask))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(turns, pa.list_(_TURN)), pa.array(losses, pa.string())], ["key", "turns", "loss_text"])

    out = mapped(source, run, f"key {kind.simpleString()}, turns array<struct<role:string,text:string>>, loss_text string")
    return out.withColumnRenamed("key", key)
