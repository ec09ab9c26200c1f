"""Repair of conversations' structure at the least cost.

Edits of a conversation are paths through a graph without cycles: a layer per row, and in it four states (nothing said
yet; a system turn; a user turn that waits for an answer; an answered one). A path's weight is one whole number: its
high digits are the cost, its low digits, three bits each from the first place on, the audit's letters, with zeros behind
the last one. So the smaller number is the cheaper repair, and of equally cheap ones that whose audit comes first; the
ordinary minimum over numbers decides everything. Within a layer and state, equally cheap audits are never a leading part
of each other (as many letters belong to rows, and an insertion costs), so what is smaller stays so.

Rows stream in order, one partition after another, and of a conversation only the states are held: a weight, the audit's length
and the running digest of the repaired text each. Places are as wide as a block of rows needs: at a block's end, the
letters that all states share are settled and leave the numbers, so these stay short and time linear in a conversation's
length, however long it is. The text that a conversation becomes has one digest, so its rows pass through one task, in constant
memory but for the audit itself.
"""

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.storage import map_batches
from docrecon.llm.text import BLANKS

# Costs of edits, letters of the audit as octal digits in their order.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
START, SYSTEM, USER, DONE = range(4)
#: State after a role's initial in a state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, DONE: USER}, "a": {USER: DONE}}
NAMES = {"u": b"user:", "a": b"assistant:"}
#: Rows between two settlements, and letters that a row can add: two insertions and its own.
BLOCK_ROWS, ROW_LETTERS = 64, 3
NONE, BLANK, DUPLICATE, CUT = range(4)
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Repair:
    """The cheapest repair of the rows added so far."""

    def __init__(self):
        from hashlib import sha256

        self.cost, self.settled, self.rows = 0, [], 0
        self._lay_out({START: (0, "", sha256())})

    def _lay_out(self, states: dict) -> None:
        """States (cost, letters, digest) as numbers with room for a block of rows."""
        self.width = max(len(x) for _, x, _ in states.values()) + ROW_LETTERS * (BLOCK_ROWS + 1)
        self.states = {s: (c << 3 * self.width | int(x.ljust(self.width, "0"), 8), len(x), h) for s, (c, x, h) in states.items()}

    def _read(self, weight: int, length: int) -> tuple[int, str]:
        return weight >> 3 * self.width, f"{weight & ((1 << 3 * self.width) - 1):0{self.width}o}"[:length]

    def _settle(self) -> None:
        read = {s: (*self._read(w, n), h) for s, (w, n, h) in self.states.items()}
        shared, least = commonprefix([x for _, x, _ in read.values()]), min(c for c, _, _ in read.values())
        self.settled.append(shared)
        self.cost += least
        self._lay_out({s: (c - least, x[len(shared) :], h) for s, (c, x, h) in read.items()})

    def _offer(self, to: dict, state: int, source: int, letter: str, cost: int, said: bytes | None) -> None:
        """A path from a source state on, if it is the least to a state so far."""
        weight, length, digest = (to if letter == "I" else self.states)[source]
        weight += (cost << 3 * self.width) + (LETTERS[letter] << 3 * (self.width - 1 - length))
        if state not in to or weight < to[state][0]:
            to[state] = (weight, length + 1, digest if said is None else (digest, said if source == START else b"\n" + said))

    def _insert(self, to: dict) -> dict:
        """The states that insertions reach too, with digests brought up to date."""
        _update(to)
        for letter in ("u", "a"):
            for source, state in STEPS[letter].items():
                if source in to:
                    self._offer(to, state, source, "I", INSERT, NAMES[letter])
            _update(to)
        return to

    def add(self, role: str, text: str, fault: int) -> None:
        if self.rows == 0:
            self.states = self._insert(dict(self.states))
        elif self.rows % BLOCK_ROWS == 0:
            self._settle()
        self.rows += 1
        to, own = {}, text.encode("utf-8", "surrogatepass")
        more = TRUNCATED if fault == CUT else 0
        for source in self.states:
            self._offer(to, source, source, "D", DELETE, None)
        if fault in (NONE, CUT):
            initial = role[:1]
            for letter, steps in STEPS.items():
                for source, state in steps.items():
                    if source in self.states and letter == initial:
                        self._offer(to, state, source, "K", more, role.encode("utf-8", "surrogatepass") + b":" + own)
                    if source in self.states and letter in NAMES:
                        self._offer(to, state, source, "R", REROLE + more, NAMES[letter] + own)
        self.states = self._insert(to)

    def best(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the least path to an end."""
        weight, length, digest = min((self.states[s] for s in (START, DONE) if s in self.states), key=lambda x: x[0])
        cost, letters = self._read(weight, length)
        audit = ("".join(self.settled) + letters).translate(str.maketrans("1234", "DIKR"))
        return self.cost + cost, audit, digest.hexdigest()


def _update(to: dict) -> None:
    """Digests of chosen paths take up what these say; a path that adds nothing shares its source's."""
    for state, (weight, length, digest) in to.items():
        if isinstance(digest, tuple):
            before, said = digest
            made = before.copy()
            made.update(said)
            to[state] = (weight, length, made)


class _Conversation:
    def __init__(self, name):
        self.name, self.counts, self.illegal, self.before, self.turns, self.repair = name, [0, 0, 0, 0], 0, None, [], Repair()
        self.n_turns = 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns, self.n_turns = [self.turns[0] if self.turns else turn, turn], self.n_turns + 1
        self.repair.add(role, text, fault)

    def result(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.n_turns if self.turns else 0
        return (self.name, gaps, *self.counts[1:], self.illegal, *self.repair.best())


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as damage leaves them: _conv, _turn, _role, _text, _here. A dropped row stays as a mark that its conversation
    was there (_here false)."""
    name = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.crc32(name) % 20
    said, speaker = F.coalesce(F.col(text).cast("string"), F.lit(" ")), F.coalesce(F.col(role).cast("string"), F.lit(" "))
    found = rows.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), speaker.alias("_role"), said.alias("_text"), kind.alias("_kind"))
    found = found.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new_text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).when(F.col("_kind") > 0, F.col("_text"))
    new_role = F.when(F.col("_kind") == 4, "user").when(F.col("_kind") > 0, F.col("_role"))
    return found.select("_conv", "_turn", new_role.alias("_role"), new_text.alias("_text"), (F.col("_kind") > 0).alias("_here"))


def _fault(repeated: Column) -> Column:
    bare = F.btrim("_text", F.lit(BLANKS))
    return F.when(bare == "", BLANK).when(repeated, DUPLICATE).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(CUT)


def repair_conversations(rows: DataFrame, conv: str = "_conv", turn: str = "_turn", role: str = "_role", text: str = "_text", here: str | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand in the order of their turns, nulls first; rows of one turn in that of role and text. A row whose `here` is
    false only says that its conversation exists; one without other rows has zeros and an empty audit. A null conversation
    id is a conversation of its own; null roles and texts count as one space, which no edit can keep. A role is known by its
    first letter; one without any cannot be kept. Repeated rows are duplicates of their first. An empty table gives no rows;
    other columns are not read. Texts and conversations of any length are read whole.
    """

    def run(batches):
        import pyarrow as pa

        kinds, now, done = None, None, []

        def out():
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [conv, *(x.split()[0] for x in RESULT.split(", "))])

        for batch in batches:
            kinds = kinds or [batch.schema.field("_conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for name, t, r, x, fault, exists in zip(*(batch.column(c).to_pylist() for c in ("_conv", "_turn", "_role", "_text", "_fault", "_here")), strict=True):
                if now is None or now.name != name:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(name)
                if exists:
                    now.add(t, r, x, fault)
                if len(done) >= 500:
                    yield out()
                    done = []
        if now is not None:
            done.append(now.result())
            yield out()

    chosen = rows.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.coalesce(role, F.lit(" ")).alias("_role"), F.coalesce(text, F.lit(" ")).alias("_text"), (F.col(here) if here else F.lit(True)).alias("_here"))
    same = Window.partitionBy("_conv", "_here", "_role", "_text").orderBy(F.col("_turn").asc_nulls_first())
    # one shuffle: rows of a conversation are together for the window and for the stream
    told = chosen.repartition("_conv").withColumn("_fault", _fault(F.row_number().over(same) > 1))
    ordered = told.sortWithinPartitions("_conv", F.col("_turn").asc_nulls_first(), "_role", "_text")
    return map_batches(ordered, run, f"`{conv}` {chosen.schema['_conv'].dataType.simpleString()}, {RESULT}")
