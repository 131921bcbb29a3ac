"""Repair of conversations by the cheapest edits that give them a lawful order of roles.

Roles must follow the grammar (s?(ua)+)? of their initials: nothing, or a system turn at most and then user and
assistant in turn. A turn is kept, given the role that is due, or deleted; turns without text may be put in anywhere.
For each conversation the cost that remains is computed backwards for every turn and grammar state; the walk forwards
takes, of the edits that are tight with that cost, the one whose letter is least. As each letter leads to one state,
the letters that come out are the ASCII-least of all cheapest edits.

Rows go to their conversation's task in two sorted streams. The first carries no texts, but each row's role, faults
and digest; of a conversation a task holds one byte a row (the audit, one cell of the result, has a letter a row in
any case). The second carries the texts past the finished audit, so that neither a conversation's texts nor a hot
conversation are ever held; only a digest over a whole conversation makes one task read all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import arrow, arrow_map

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

# Grammar states: nothing so far, a system turn, a user turn, an assistant turn; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)  # the state after the user or assistant turn that is due
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
MAY_END = (START, ASSISTANT)
#: By a role's initial: the state after each state, None where it is not lawful.
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
INITIALS = "sua"
LAWFUL = {"su", "ua", "au"}
OTHER = len(INITIALS)
SOUND, CUT_OFF, DOOMED = range(3)  # what a row's faults mean to its edits


def code(initial: str, state: int) -> int:
    """A row in one byte: its role's initial and what its faults mean."""
    at = INITIALS.find(initial) if initial else OTHER
    return 3 * (at if at >= 0 else OTHER) + state


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of a conversation, the ASCII-least of them; codes: its rows, in order."""
    ends = [0 if s in MAY_END else INSERT_COST for s in range(4)]
    ends[SYSTEM] = INSERT_COST + ends[USER]
    steps = {}
    for c in set(codes):
        at, state = divmod(c, 3)
        keep = AFTER[INITIALS[at]] if at < OTHER else (None,) * 4
        steps[c] = (state == DOOMED, TRUNCATED_COST if state == CUT_OFF else 0, keep)
    go = tuple(ends)
    tight = bytearray(len(codes))  # two bits for each state: the letter's place in DIKR
    for i in range(len(codes) - 1, -1, -1):
        doomed, extra, keep = steps[codes[i]]
        cost = [DELETE_COST + c for c in go]
        if not doomed:
            for s in range(4):
                cost[s] = min(cost[s], REROLE_COST + extra + go[DUE[s]])
                if keep[s] is not None:
                    cost[s] = min(cost[s], extra + go[keep[s]])
        cost[USER] = min(cost[USER], INSERT_COST + cost[ASSISTANT])
        cost[ASSISTANT] = min(cost[ASSISTANT], INSERT_COST + cost[USER])
        cost[START] = min(cost[START], INSERT_COST + cost[USER])
        cost[SYSTEM] = min(cost[SYSTEM], INSERT_COST + cost[USER])
        letters = 0
        for s in range(4):
            if cost[s] == DELETE_COST + go[s]:
                letter = 0
            elif cost[s] == INSERT_COST + cost[DUE[s]]:
                letter = 1
            elif keep[s] is not None and cost[s] == extra + go[keep[s]]:
                letter = 2
            else:
                letter = 3
            letters |= letter << (2 * s)
        tight[i] = letters
        go = tuple(cost)
    walk, i, s = [], 0, START
    while i < len(codes) or s not in MAY_END:
        letter = tight[i] >> (2 * s) & 3 if i < len(codes) else 1
        walk.append("DIKR"[letter])
        if letter == 2:
            s = steps[codes[i]][2][s]
        elif letter:
            s = DUE[s]
        i += letter != 1
    return go[START], "".join(walk)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns after seeded damage, with copies (0: dropped, 2: repeated). Nulls in role and text become a space."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = (F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20).cast("int")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(words[3], ".!?", "")).otherwise(words[3])
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(words[2]).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _prepared(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"), digest.alias("digest"))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
AUDITED = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
_ROW = ("conv_id", "turn", "initial", "digest", "blank", "seen", "truncated", "copies")


class _Conversation:
    """What is kept of a conversation while its rows go by."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.first, self.last, self.turns = conv_id, bytearray(), None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = self.row = None

    def add(self, turn, initial, digest, blank, seen, truncated, copies) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        for _ in range(copies):
            repeated, self.row = seen or self.row == (turn, digest), (turn, digest)
            self.blank += blank
            self.duplicate += repeated and not blank
            self.truncated += truncated and not repeated
            self.illegal += self.initial is not None and self.initial + initial not in LAWFUL
            self.initial = initial
            self.codes.append(code(initial, DOOMED if blank or repeated else CUT_OFF if truncated else SOUND))

    def audit(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest_edits(bytes(self.codes)))


def _audits(id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), *AUDITED])

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, letters = None, [], 0
        for batch in batches:
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in _ROW), strict=True):
                if held is None or conv_id != held.conv_id:
                    if held is not None:
                        out.append(held.audit())
                        letters += len(out[-1][-1])
                    held = _Conversation(conv_id)
                held.add(*row)
            if letters > 1 << 20 or len(out) > 1 << 12:
                yield arrow(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                out, letters = [], 0
        if held is not None:
            out.append(held.audit())
        if out:
            yield arrow(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    return audits


def audits(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text and, if there, copies): its faults, and the cheapest edits.

    Rows are taken by turn (null first), those of a turn by role and then by digest; nulls in role and text are a space; copies
    says how often a row stands there (0: not at all). Equal rows are duplicates after the first; conversations without rows
    have zeros and an empty audit; a role that is empty or no word in s, u or a can't be kept. Other columns are ignored.
    """
    kept = _trimmed(F.col("text"))
    rows = _prepared(turns).select(
        "conv_id", "turn", "role", "digest", "copies", F.substring("role", 1, 1).alias("initial"), (kept == "").alias("blank"), ((kept != "") & ~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("truncated"), (F.col("copies") == 0).alias("gone")
    )
    rows = rows.repartition("conv_id").withColumn("seen", F.rank().over(Window.partitionBy("conv_id", "digest", "gone").orderBy("turn")) > 1)
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "digest")
    kind = turns.schema["conv_id"].dataType
    return rows.select(*_ROW).transform(arrow_map(_audits(_arrow_type(kind)), f"conv_id {kind.simpleString()}, {AUDIT}"))


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _beside_audits(turns: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task."""
    texts = _prepared(turns).where("copies > 0").withColumn("kind", F.lit(1))
    found = audits(turns).withColumn("kind", F.lit(0))
    both = found.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


def _repaired(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """(audit's row, None) where a conversation begins, and (edit, role, text) for each turn of the repaired one."""
    letters, at, state = "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(letters) and letters[at] == INSERT:
            at, state = at + 1, DUE[state]
            yield INSERT, ROLE_OF[state], ""

    for batch in batches:
        for kind, role, text, copies, *audit in zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text", "copies", *names)), strict=True):
            if not kind:
                yield from inserted()
                letters, at, state = audit[-1], 0, START
                yield audit, None
                continue
            for _ in range(copies):
                yield from inserted()
                letter, at = letters[at], at + 1
                if letter != DELETE:
                    state = AFTER[role[0]][state] if letter == KEEP else DUE[state]
                    yield letter, role if letter == KEEP else ROLE_OF[state], text
    yield from inserted()


def _encoded(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text. See audits() for how rows are read."""
    kind = turns.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", _arrow_type(kind)), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, position, out, size = None, 0, [], 0
        for x in _repaired(batches, ["conv_id", "audit"]):
            if x[1] is None:
                conv_id, position = x[0][0], 0
                continue
            out.append((conv_id, position, *x))
            position, size = position + 1, size + len(x[2])
            if size > 1 << 22 or len(out) > 1 << 13:
                yield arrow(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                out, size = [], 0
        if out:
            yield arrow(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    return _beside_audits(turns).transform(arrow_map(run, f"conv_id {kind.simpleString()}, position long, edit string, role string, text string"))


def audits_with_digest(turns: DataFrame) -> DataFrame:
    """audits(), and repaired_sha256: of the repaired turns as role:text, joined by newlines."""
    kind = turns.schema["conv_id"].dataType
    names = ["conv_id", *(c for c, _ in AUDITED)]
    schema = pa.schema([("conv_id", _arrow_type(kind)), *AUDITED, ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, any_turn, out, letters = None, None, False, [], 0
        for x in _repaired(batches, names):
            if x[1] is not None:
                sha.update((b"\n" if any_turn else b"") + _encoded(*x[1:]))
                any_turn = True
                continue
            if audit is not None:
                out.append((*audit, sha.hexdigest()))
                letters += len(audit[-1])
            audit, sha, any_turn = x[0], hashlib.sha256(), False
            if letters > 1 << 20 or len(out) > 1 << 12:
                yield arrow(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                out, letters = [], 0
        if audit is not None:
            out.append((*audit, sha.hexdigest()))
        if out:
            yield arrow(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    return _beside_audits(turns).transform(arrow_map(run, f"conv_id {kind.simpleString()}, {AUDIT}, repaired_sha256 string"))
