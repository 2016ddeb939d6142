"""Chat formatting: records of different layouts become canonical turns, then one marked-up text with a loss mask."""

import hashlib
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# --- layouts -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class One:
    """A turn of a fixed role whose text stands in one or more fields, joined by an empty line; none if all are null."""

    role: str
    paths: tuple[str, ...]

    def turns(self) -> Column:
        first, *rest = [F.coalesce(F.col(p), F.lit("")) for p in self.paths]
        text = F.concat(first, *[F.when(t != "", F.concat(F.lit("\n\n"), t)).otherwise(F.lit("")) for t in rest])
        some = F.coalesce(*[F.col(p) for p in self.paths]).isNotNull()
        return F.when(some, F.array(_turn(F.lit(self.role), text))).otherwise(_no_turns())


@dataclass(frozen=True)
class Each:
    """A turn per element of an array of structs; ``roles`` gives the canonical names of the layout's own."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def turns(self) -> Column:
        def one(e):
            role = e[self.role]
            for theirs, ours in self.roles:
                role = F.when(e[self.role] == theirs, F.lit(ours)).otherwise(role)
            return _turn(role, e[self.text])

        return F.coalesce(F.transform(F.col(self.path), one), _no_turns())


@dataclass(frozen=True)
class Pairs:
    """Turns of two roles in alternation from an array of arrays of texts."""

    path: str
    roles: tuple[str, str] = ("user", "assistant")

    def turns(self) -> Column:
        def pair(texts):
            return F.transform(texts, lambda t, i: _turn(F.when(i % 2 == 0, self.roles[0]).otherwise(self.roles[1]), t))

        return F.coalesce(F.flatten(F.transform(F.col(self.path), pair)), _no_turns())


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _no_turns() -> Column:
    return F.array().cast("array<struct<role: string, text: string>>")


@dataclass(frozen=True)
class Layout:
    """A mapping from field paths to turns. ``[]`` in a path stands for the elements of an array."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    parts: tuple = field(default=())

    def fingerprints(self) -> list[str]:
        """The hashes of every set of paths that a record of this layout can have."""
        chosen = itertools.chain.from_iterable(
            itertools.combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return [path_hash([*self.required, *some]) for some in chosen]

    def turns(self) -> Column:
        return F.concat(*[p.turns() for p in self.parts])


def path_hash(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


SHARE_ROLES = (("human", "user"), ("gpt", "assistant"))
ASKED, ANSWERED, RULES = One("user", ("instruction", "input")), One("assistant", ("output",)), One("system", ("system",))
LAYOUTS = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), (Each("messages", "role", "content"),)),
    Layout("share", ("conversations[]",), ("conversations[].from", "conversations[].value", "system"),
           (RULES, Each("conversations", "from", "value", SHARE_ROLES))),
    Layout("instruction", ("instruction",), ("input", "output", "system"), (RULES, ASKED, ANSWERED)),
    Layout("history", ("history[]", "instruction"), ("history[][]", "input", "output", "system"),
           (RULES, Pairs("history"), ASKED, ANSWERED)),
    Layout("prompt", ("prompt",), ("completion", "system"), (RULES, One("user", ("prompt",)), One("assistant", ("completion",)))),
)
FIELDS = {
    "messages": "array<struct<role: string, content: string>>",
    "conversations": "array<struct<from: string, value: string>>",
    "history": "array<array<string>>",
    **dict.fromkeys(("system", "instruction", "input", "output", "prompt", "completion"), "string"),
}


def read_records(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """JSON lines of any mix of the layouts, with ``extra`` columns (a DDL list) beside them."""
    own = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
    return spark.read.schema(f"{own}, {extra}" if extra else own).json(path)


def _at(schema, path: str):
    """The type at a path of a schema, or None."""
    here = schema
    for step in re.findall(r"\[\]|[^.\[\]]+", path):
        if step == "[]":
            here = here.elementType if isinstance(here, ArrayType) else None
        else:
            here = here[step].dataType if isinstance(here, StructType) and step in here.fieldNames() else None
        if here is None:
            return None
    return here


def _counts(schema: StructType, path: str) -> bool:
    """Whether a schema has a text, or for a path that ends in ``[]`` an array, at the path."""
    kind = _at(schema, path)
    return isinstance(kind, StringType) or kind is not None and path.endswith("[]")


def _present(value: Column, steps: list[str]) -> Column:
    if not steps:
        return value.isNotNull()
    if steps[0] != "[]":
        return _present(value[steps[0]], steps[1:])
    if len(steps) == 1:
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(F.exists(value, lambda e: F.coalesce(_present(e, steps[1:]), F.lit(False))), F.lit(False))


def fingerprint(schema: StructType, layouts=LAYOUTS) -> Column:
    """Hash of the nested field paths of the layouts that a record has; a path of another type than text counts as absent."""
    paths = sorted({p for x in layouts for p in (*x.required, *x.optional)})
    found = []
    for path in paths:
        if _counts(schema, path):
            first, *steps = re.findall(r"\[\]|[^.\[\]]+", path)
            found.append(F.when(_present(F.col(first), steps), F.lit(path)))
    return F.md5(F.concat_ws("\n", *found))


def _known(schema: StructType, layout: Layout) -> bool:
    return all(_counts(schema, p) for p in (*layout.required, *layout.optional))


def canonical_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """The records with layout and turns (array of role and text) in place of their layout's fields.

    A layout is chosen by the hash of the record's field paths, looked up in the table of all hashes that the layouts allow.
    A record that none of them allows keeps null layout and turns. The columns must hold all fields of a layout
    (``read_records`` gives them), or the layout is not used.
    """
    usable = [x for x in layouts if _known(records.schema, x)]
    table = {}
    for layout in usable:
        for print_ in layout.fingerprints():
            if table.setdefault(print_, layout.name) != layout.name:
                raise ValueError(f"layouts {table[print_]} and {layout.name} allow the same paths")
    own = {re.split(r"[.\[]", p)[0] for x in usable for p in (*x.required, *x.optional)}
    kept = [c for c in records.columns if c not in own | {"fingerprint", "layout", "turns"}]
    marked = records.withColumn("fingerprint", fingerprint(records.schema, usable))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for layout in usable:
        mine = F.col("fingerprint").isin(sorted(k for k, v in table.items() if v == layout.name))
        name = F.when(mine, F.lit(layout.name)).otherwise(name)
        turns = F.when(mine, layout.turns()).otherwise(turns)
    return marked.select(*kept, "fingerprint", name.alias("layout"), turns.alias("turns"))


# --- template ------------------------------------------------------------------------------------

# fixed values: strings that mark turns in templates in public use
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Template:
    """Turns as ``open role newline text close``; texts of ``loss_roles`` are trained on.

    A control string in a text gets a backslash after its first character, and one that already has backslashes there gets one
    more; taking one away gives the text back. No control string may overlap another.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = CONTROLS
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if "\\" in "".join(self.controls) or any(len(c) < 2 for c in self.controls):
            raise ValueError("control strings have at least two characters and no backslash")
        if not all(any(c in mark for c in self.controls) for mark in (self.open, self.close)):
            raise ValueError("the marks must be made of control strings, or a text could fake them")
        full = [f + c[1:] for c in self.controls for f in {c[0] for c in self.controls}]
        for a, b in itertools.product(full, full):
            if any(a[k:].startswith(b) or b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"control strings overlap: {a} {b}")

    def _pattern(self, slashes: str) -> str:
        first = "".join(re.escape(c) for c in sorted({c[0] for c in self.controls}))
        rest = "|".join(re.escape(c[1:]) for c in self.controls)
        return f"([{first}]){slashes}({rest})"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"(\\*)"), r"$1\\$2$3")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\(\\*)"), "$1$2$3")

    def head(self, role: Column) -> Column:
        """What stands before a text; a line break in a role is written as %0A, a percent sign as %25."""
        name = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
        return F.concat(F.lit(self.open), self.escaped(name), F.lit("\n"))

    def role_of(self, head: Column) -> Column:
        name = self.unescaped(head)
        return F.replace(F.replace(name, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


CHUNK = 1024


def sums_before(values: Column) -> Column:
    """For every number of an array the sum of those before it, by chunks, so that long arrays are not copied per element."""
    def running(numbers):
        return F.slice(F.aggregate(
            numbers, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(1), F.size(numbers))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))
    offsets = running(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)))
    within = F.transform(chunks, lambda c: running(c))
    placed = F.zip_with(within, offsets, lambda starts, offset: F.transform(starts, lambda s: s + offset))
    return F.when(F.size(values) > 0, F.flatten(placed)).when(values.isNotNull(), F.array().cast("array<bigint>"))


def formatted_chats(canonical: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows of ``canonical_turns`` with formatted, the text of all turns, and loss, a span per turn.

    A span (start from 1, chars; in code points of ``formatted``) covers the text of a turn of a loss role and is empty for others.
    """
    parts = F.transform("turns", lambda t: F.struct(
        template.head(t["role"]).alias("head"), template.escaped(t["text"]).alias("body"), t["role"].isin(list(template.loss_roles)).alias("loss")))
    close = F.lit(template.close)
    sized = F.transform("parts", lambda p: F.struct(
        F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body"), p["loss"].alias("loss")))
    whole = F.transform("sized", lambda s: s["head"] + s["body"] + len(template.close))
    spans = F.zip_with("sized", "before", lambda s, at: F.struct(
        (at + s["head"] + 1).alias("start"), F.when(s["loss"], s["body"]).otherwise(F.lit(0).cast("long")).alias("chars")))
    kept = [F.col(c) for c in canonical.columns if c not in ("turns", "formatted", "loss")]
    return (
        canonical.withColumn("parts", parts).withColumn("sized", sized).withColumn("before", sums_before(whole))
        .select(*kept, F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], close)), "").alias("formatted"), spans.alias("loss"))
    )


def chat_format(records: DataFrame, layouts=LAYOUTS, template: Template = Template()) -> DataFrame:
    """Records of mixed layouts as one training text each: fingerprint, layout, formatted and loss beside their other columns.

    Every step works inside a row, so nothing is shuffled. A row holds a whole conversation, whatever its length.

    Defined results: a null text or role is empty; a record without a known set of paths (nothing but nulls, fields of two
    layouts) has null layout, formatted and loss; a record of no turns cannot be told from none; repeated rows are formatted
    one by one; an empty table gives no rows; other columns stay, but input columns called like the new ones are replaced,
    and fields called like those of a layout but of another type do not count.
    """
    return formatted_chats(canonical_turns(records, layouts), template)


# --- reading back --------------------------------------------------------------------------------


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows of ``chat_format`` with turns, read from the text, and loss_texts, one per span that is not empty, both unescaped."""
    cut = F.split("formatted", re.escape(template.close))
    pieces = F.slice(cut, F.lit(1), F.size(cut) - 1)

    def turn(piece):
        inner = F.substring(piece, F.lit(len(template.open) + 1), F.length(piece))
        line = F.instr(inner, F.lit("\n"))
        return F.struct(
            template.role_of(F.substring(inner, F.lit(1), line - 1)).alias("role"),
            template.unescaped(F.substring(inner, line + 1, F.length(inner))).alias("text"))

    begins = sums_before(F.transform("pieces", lambda p: F.length(p).cast("long") + len(template.close)))
    inside = F.zip_with(F.col("loss"), F.col("begins"), lambda span, at: F.struct((span["start"] - at).cast("int").alias("start"), span["chars"].cast("int").alias("chars")))
    texts = F.zip_with(F.col("pieces"), F.col("inside"), lambda p, s: F.when(s["chars"] > 0, template.unescaped(F.substring(p, s["start"], s["chars"]))))
    return (
        chats.withColumn("pieces", pieces).withColumn("begins", begins).withColumn("inside", inside)
        .withColumn("turns", F.transform("pieces", turn)).withColumn("loss_texts", F.filter(texts, lambda t: t.isNotNull()))
        .drop("pieces", "begins", "inside")
    )
