r"""Chat formatting with a grammar round trip.

    conversation = "<|begin|>\n" turn* "<|finish|>\n"
    turn         = ("<|turn|>" | "<|turn+|>") role "\n" body "<|end|>\n"

A role is percent-encoded. The body of ``<|turn|>`` is the text as it is, that
of ``<|turn+|>`` has each backslash doubled and a backslash after the first
character of each control string. A turn is rendered, parsed again and compared
with its source; if it differs, or still shows a control string, it is rendered
escaped, and that has to come back identical.
"""

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.shared import ship

BEGIN, FINISH = "<|begin|>\n", "<|finish|>\n"
# Strings that this template or others in use give a meaning.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<\|turn(\+?)\|>([^\n]*)\n(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

SEGMENTS = "conv_id bigint, place int, turn {turn}, role string, segment string, body_start int, body_end int, escaped boolean, loss boolean"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    out = text.replace("\\", "\\\\")
    while _CONTROL.search(out):  # one pass can leave a string that overlapped another
        out = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], out)
    return out


def unescape(body: str) -> str:
    return _ESCAPED.sub(r"\1", body)


def parse_turn(segment: str, at: int = 0) -> tuple[str, str, int, int, bool, int]:
    """(role, text, start and end of the body, whether it was escaped, end of the turn) at a place of a rendered text."""
    m = _TURN.match(segment, at)
    if not m:
        raise ValueError(f"no turn at {at}")
    return unquote(m[2]), unescape(m[3]) if m[1] else m[3], m.start(3), m.end(3), bool(m[1]), m.end()


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a whole rendered conversation."""
    if not text.startswith(BEGIN):
        raise ValueError("no beginning")
    at, turns = len(BEGIN), []
    while not text.startswith(FINISH, at):
        role, body, *_, at = parse_turn(text, at)
        turns.append((role, body))
    if at + len(FINISH) != len(text):
        raise ValueError("text after the end")
    return turns


def render_turn(role: str, text: str) -> str:
    head = quote(role, safe="")
    for mark, body in (("<|turn|>", text), ("<|turn+|>", escape(text))):
        out = f"{mark}{head}\n{body}<|end|>\n"
        try:
            back = parse_turn(out)
        except ValueError:
            continue
        if back[:2] == (role, text) and back[5] == len(out) and not _CONTROL.search(body):
            return out
    raise ValueError("a turn can't be rendered")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rendered segments (conv_id, place, turn, role, segment, body_start, body_end, escaped, loss) of rows (conv_id, turn, role, text).

    A conversation is its segments in the order that ``in_order`` gives: the
    beginning (place 0), a segment per turn (1), the end (2). A body lies from
    body_start to body_end of its segment; loss says whether it is learnt, as an
    assistant's is. Order: turn (null first), then role, then text; null role and
    text are empty; repeated rows are turns each; rows with a null conv_id are
    one conversation. No rows give no segments. Long texts are rendered whole, a
    turn at a time. A turn is rendered where its row lies, so no conversation,
    however long, gathers anywhere; only distinct conv_ids are shuffled.
    """
    ship(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def render(batches):
        for batch in batches:
            roles = batch.column("role").to_pylist()
            segments = [render_turn(r, t) for r, t in zip(roles, batch.column("text").to_pylist())]
            parsed = [parse_turn(s) for s in segments]
            yield pa.record_batch(
                [
                    batch.column("conv_id"),
                    pa.array([1] * len(roles), pa.int32()),
                    batch.column("turn"),
                    batch.column("role"),
                    pa.array(segments, pa.string()),
                    pa.array([p[2] for p in parsed], pa.int32()),
                    pa.array([p[3] for p in parsed], pa.int32()),
                    pa.array([p[4] for p in parsed], pa.bool_()),
                    pa.array([r == "assistant" for r in roles], pa.bool_()),
                ],
                ["conv_id", "place", "turn", "role", "segment", "body_start", "body_end", "escaped", "loss"],
            )

    schema = SEGMENTS.format(turn=rows.schema["turn"].dataType.simpleString())
    ends = F.array(F.struct(F.lit(0).alias("place"), F.lit(BEGIN).alias("segment")), F.struct(F.lit(2).alias("place"), F.lit(FINISH).alias("segment")))
    frames = rows.select("conv_id").distinct().select("conv_id", F.inline(ends))
    return rows.mapInArrow(render, schema).unionByName(frames, allowMissingColumns=True)


def in_order(segments: DataFrame) -> DataFrame:
    """Conversations dealt to tasks, the segments of each in their order; turns alike in number and role go by text, taken from the segment."""
    body = F.substring("segment", F.col("body_start") + 1, F.col("body_end") - F.col("body_start"))
    text = F.when(F.col("escaped"), F.regexp_replace(body, r"(?s)\\(.)", "$1")).otherwise(body)
    return segments.repartition("conv_id").withColumn("text", text).sortWithinPartitions("conv_id", "place", "turn", "role", "text").drop("text")


def digest_conversations(segments: DataFrame) -> DataFrame:
    """Per conversation, parsed from its segments: turns, loss text and length.

    A digest has to be taken in order, so a conversation is one stream over
    sorted segments, of which a task holds a batch at a time.
    """
    ship(segments.sparkSession)
    ordered = in_order(segments).select("conv_id", "segment", "loss")

    def digest(batches):
        conv = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                segment = r["segment"]
                if segment == BEGIN:
                    conv, n, chars, loss_chars, turns, loss = r["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                elif segment != FINISH:
                    role, text, _, _, _, end = parse_turn(segment)
                    if end != len(segment):
                        raise ValueError("text after a turn")
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                    if r["loss"]:
                        loss.update(text.encode())
                        loss_chars += len(text)
                chars += len(segment)
                if segment == FINISH:
                    done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if done:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    return ordered.mapInArrow(digest, DIGESTS)
