"""Chat records of many layouts brought to canonical turns and written out in one template.

A record is a VARIANT: a whole conversation or one turn of it. The paths of its nested fields, without their types,
are hashed to a fingerprint, and the fingerprint selects a declarative ``Layout`` that says where the turns
are. A turn is written as ``<|im_start|>role``, a line break, its text and ``<|im_end|>`` with a line break; the texts of
assistants stand under the loss mask. Only SQL functions are used.

Defined results:

* a record that is null or whose fields fit no layout has no turns; ``unmatched`` counts such records by fingerprint;
* a null role or text is empty; a conversation has its turns by position (null first), equal ones by role and text, and a
  repeated row is a turn of its own; rows of a null id are one conversation;
* in texts and roles every ``<|``, also with backslashes between, gets one backslash more, so no control string can come
  from a text; line breaks and percent signs of a role are written as ``%0A`` and ``%25``. Both are undone exactly;
* a conversation becomes one row, so it has to fit one; all steps are linear in its length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the control strings of the template
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"

_SCALAR = r"[A-Z_]+(?:\([0-9, ]*\))?"


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role. Its text is that of the fields at ``texts``, an empty line between two; there is no
    turn when all of them are optional and missing or null."""

    role: str
    texts: tuple[str, ...]

    def paths(self) -> set[str]:
        return set(self.texts)

    def turns(self, record: Column, optional: frozenset[str]) -> Column:
        fields = [_field(record, path) for path in self.texts]
        turn = F.array(_turn(F.lit(self.role), F.concat_ws("\n\n", *fields)))
        if not self.paths() <= optional:
            return turn
        return F.when(F.coalesce(*fields).isNotNull(), turn).otherwise(F.filter(turn, lambda t: F.lit(False)))


@dataclass(frozen=True)
class Listed:
    """The turns are the objects of the array at ``path``; ``role`` and ``text`` are their fields."""

    path: str
    role: str
    text: str

    def paths(self) -> set[str]:
        return {f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"}

    def turns(self, record: Column, optional: frozenset[str]) -> Column:
        kind = f"array<struct<`{self.role}`:string,`{self.text}`:string>>"
        items = F.filter(F.try_variant_get(record, f"$.{self.path}", kind), lambda i: i.isNotNull())
        return F.coalesce(F.transform(items, lambda i: _turn(i[self.role], i[self.text])), F.array().cast(_TURNS))


@dataclass(frozen=True)
class Single:
    """The record is one turn of its conversation; ``order`` is its place."""

    order: str
    role: str
    text: str

    def paths(self) -> set[str]:
        return {self.order, self.role, self.text}

    def turns(self, record: Column, optional: frozenset[str]) -> Column:
        place = F.try_variant_get(record, f"$.{self.order}", "bigint")
        return F.array(_turn(_field(record, self.role), _field(record, self.text), place))


_TURNS = "array<struct<position:bigint,role:string,text:string>>"


def _field(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _turn(role: Column, text: Column, place: Column | None = None) -> Column:
    place = F.lit(None).cast("bigint") if place is None else place
    turn = F.struct(place.alias("position"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return turn.cast("struct<position:bigint,role:string,text:string>")


@dataclass(frozen=True)
class Layout:
    """Declares where a layout keeps its turns.

    ``optional`` are paths that may be absent, ``also`` further ones that are there but say nothing, and ``roles`` the names
    the layout has for canonical roles.
    """

    name: str
    parts: tuple[Said | Listed | Single, ...]
    optional: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def shapes(self) -> set[str]:
        """Every set of field paths this layout can show, in the form of ``shape``."""
        paths = reduce(set.union, (part.paths() for part in self.parts), set(self.also)) - set(self.optional)
        lists = {part.path for part in self.parts if isinstance(part, Listed)}
        shown = set()
        for n in range(len(self.optional) + 1):
            for chosen in combinations(self.optional, n):
                present = paths | set(chosen)
                bare = {p for p in present if p.partition("[]")[0] not in lists}
                # a list without elements shows no fields below it, a null in its place no list
                shown |= {_written(_nested(p)) for p in (present, bare | {f"{x}[]" for x in lists}, bare | lists)}
        return shown

    def turns(self, record: Column) -> Column:
        optional = frozenset(self.optional)
        told = F.concat(*[part.turns(record, optional) for part in self.parts])
        names = dict(self.roles)

        def canonical(turn: Column, place: Column) -> Column:
            role = turn["role"]
            for given, name in names.items():
                role = F.when(turn["role"] == given, F.lit(name)).otherwise(role)
            place = F.coalesce(turn["position"], place.cast("bigint"))
            if any(isinstance(part, Single) for part in self.parts):
                place = turn["position"]
            return F.struct(place.alias("position"), role.alias("role"), turn["text"].alias("text"))

        return F.transform(told, canonical)


def _nested(paths: set[str]) -> dict:
    """Field paths as a tree; ``a[].b`` is field ``b`` of the elements of ``a``."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.replace("[]", ".[]").split("."):
            at = at.setdefault(step, {})
    return tree


def _written(tree: dict) -> str:
    if not tree:
        return ""
    if "[]" in tree:
        return f"ARRAY<{_written(tree['[]'])}>"
    fields = [f"{name}: {_written(below)}" if below else name for name, below in sorted(tree.items())]
    return f"OBJECT<{', '.join(fields)}>"


def shape(record: Column) -> Column:
    """The nested field paths of a record, types left out, fields in order of their names.

    Elements that are no objects are ``*``; an array without elements, or with nulls only, shows none.
    """
    told = F.schema_of_variant(record)
    told = F.regexp_replace(told, r"(?<=ARRAY<)VOID(?=>)", "")
    told = F.regexp_replace(told, rf"(?<=ARRAY<){_SCALAR}(?=>)", "*")
    return F.regexp_replace(told, rf": {_SCALAR}(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


_HUMAN = (("human", "user"), ("gpt", LOSS_ROLE), ("bot", LOSS_ROLE))

#: Layouts of public instruction and chat data.
LAYOUTS: tuple[Layout, ...] = (
    Layout("turn row", (Single("turn", "role", "text"),)),
    Layout("prompt", (Said("user", ("prompt",)), Said(LOSS_ROLE, ("completion",)))),
    Layout("prompt response", (Said("user", ("prompt",)), Said(LOSS_ROLE, ("response",)))),
    Layout("question", (Said("user", ("question",)), Said(LOSS_ROLE, ("answer",)))),
    Layout(
        "instruction",
        (Said("system", ("system",)), Said("user", ("instruction", "input")), Said(LOSS_ROLE, ("output",))),
        optional=("system", "input"),
    ),
    Layout(
        "messages",
        (Said("system", ("system",)), Listed("messages", "role", "content")),
        optional=("system",),
    ),
    Layout("conversations", (Listed("conversations", "from", "value"),), roles=_HUMAN),
)


def canonical_turns(
    records: DataFrame, id_col: str = "id", record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """(``id``, ``layout``, ``position``, ``role``, ``text``): the turns of all records, each read by its layout.

    Choosing a layout is comparing one hash with a few constants, so there is no join and no shuffle.
    """
    spark = records.sparkSession
    told = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
    told = told.withColumn("print", fingerprint(F.col("record")))
    named, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for layout, prints in _prints(spark, layouts):
        chosen = F.col("record").isNotNull() & F.col("print").isin(prints)
        named = F.when(chosen, F.lit(layout.name)).otherwise(named)
        turns = F.when(chosen, layout.turns(F.col("record"))).otherwise(turns)
    return told.select("id", named.alias("layout"), turns.alias("turns")).select("id", "layout", F.inline("turns"))


def _prints(spark, layouts: Sequence[Layout]) -> list[tuple[Layout, list[int]]]:
    """The fingerprints of each layout, hashed by the function that hashes the records'."""
    rows = [(number, written) for number, layout in enumerate(layouts) for written in sorted(layout.shapes())]
    hashed = spark.createDataFrame(rows, "number int, shape string").select("number", "shape", F.xxhash64("shape"))
    found: dict[int, list[int]] = {}
    owner: dict[str, int] = {}
    for number, written, value in hashed.collect():
        if owner.setdefault(written, number) != number:
            raise ValueError(f"{layouts[owner[written]].name!r} and {layouts[number].name!r} share {written}")
        found.setdefault(number, []).append(value)
    return [(layouts[number], prints) for number, prints in found.items()]


def unmatched(
    records: DataFrame, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """(``shape``, ``records``): how many records show a set of fields that no layout knows; null: not a record."""
    known = [value for _, prints in _prints(records.sparkSession, layouts) for value in prints]
    rows = records.select(shape(F.col(record_col)).alias("shape"))
    rows = rows.filter(F.col("shape").isNull() | ~F.xxhash64("shape").isin(known))
    return rows.groupBy("shape").agg(F.count(F.lit(1)).alias("records"))


def escaped(text: Column) -> Column:
    """One backslash more between ``<`` and ``|``: what is left holds no ``<|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(``id``, ``segments``): each conversation as pieces of text, in order, with the flag of the loss mask.

    ``turns`` has ``id, position, role, text``. A turn's text is escaped before it is shuffled to its conversation.
    """
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    turn = F.struct(
        F.col("position"), role.alias("plain_role"), text.alias("plain"),
    )
    gathered = turns.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        def piece(value: Column, loss: bool) -> Column:
            return F.struct(value.alias("text"), F.lit(loss).alias("loss"))

        head = F.concat(F.lit(TURN_START), escaped_role(t["plain_role"]), F.lit("\n"))
        body = escaped(t["plain"])
        masked = F.array(piece(head, False), piece(body, True), piece(F.lit(TURN_END), False))
        whole = F.array(piece(F.concat(head, body, F.lit(TURN_END)), False))
        return F.when(t["plain_role"] == LOSS_ROLE, masked).otherwise(whole)

    return gathered.select("id", F.flatten(F.transform("turns", pieces)).alias("segments"))


def formatted(segments: Column) -> Column:
    """The whole conversation as one text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_texts(segments: Column) -> Column:
    """What stands under the loss mask, piece by piece, as it was before formatting."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"]))


def read_turns(text: Column) -> Column:
    """Roles and texts of the turns, read back from a formatted conversation."""
    told = F.split(text, r"<\|im_start\|>", -1)
    told = F.slice(told, 2, F.greatest(F.size(told) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        start = F.char_length(head) + 2
        body = F.substring(piece, start, F.char_length(piece) - start + 1 - len(TURN_END))
        return F.struct(unescaped_role(head).alias("role"), unescaped(body).alias("text"))

    return F.transform(told, turn)
