"""A registry of nodes, their options, and datasets stored by lineage.

A node names what it depends on and what it provides, and computes a lazy
DataFrame.  Asking for a target loads what is stored under its lineage, computes
the rest, and saves by the node's policy.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import accumulate, all_of, overlap_pairs, positional_merge
from ..operators.selection import absolute_range, apply_selection
from ..sources.store import DatasetStore
from .lineage import short_hash


class SaveWhen(IntEnum):
    NEVER = 0
    EXPLICIT = 1
    TARGET = 2
    ALWAYS = 3


_MISSING = object()


@dataclass
class Option:
    """A setting; one without any default is required.  Untracked ones don't enter the lineage."""

    name: str
    default: object = _MISSING
    factory: Callable | None = None
    by_run: list | None = None
    track: bool = True
    kind: type | None = None
    parent: str | None = None
    fetch: Callable | None = None  # makes the value that a node gets of the one that is set; the lineage has the latter

    def value(self, config: dict, run_id: str):
        if self.name in config:
            got = config[self.name]
        elif self.default is not _MISSING:
            got = self.default
        elif self.factory is not None:
            got = self.factory()
        elif self.by_run is not None:
            before = [v for start, v in self.by_run if start <= run_id]
            if not before:
                raise ValueError(f"{self.name} has no value for run {run_id}")
            got = before[-1]
        else:
            raise ValueError(f"option {self.name} has no value")
        if self.kind is not None and not isinstance(got, self.kind):
            raise TypeError(f"option {self.name} is a {self.kind.__name__}")
        return got


@dataclass
class Node:
    """``compute(spark, run_id, config, **inputs)`` returns one DataFrame, or one for each output."""

    provides: tuple[str, ...]
    compute: Callable
    depends_on: tuple[str, ...] = ()
    options: tuple[Option, ...] = ()
    version: str = "0"
    kind: str = ""
    save: SaveWhen = SaveWhen.ALWAYS
    superruns: bool = False
    about: tuple = ()  # what else the result depends on; part of the lineage

    def __post_init__(self):
        self.provides = (self.provides,) if isinstance(self.provides, str) else tuple(self.provides)
        self.depends_on = (self.depends_on,) if isinstance(self.depends_on, str) else tuple(self.depends_on)
        self.kind = self.kind or self.provides[0]


def merge_node(name: str, depends_on: Iterable[str]) -> Node:
    """The columns of tables of one kind side by side."""
    return Node((name,), lambda spark, run_id, config, **inputs: positional_merge(list(inputs.values())), tuple(depends_on), about=("merge",))


def cut_node(name: str, depends_on: str, condition: str) -> Node:
    """A column that tells which rows pass; ``condition`` is Spark SQL."""
    return Node((name,), lambda spark, run_id, config, **inputs: inputs[depends_on].select("run_id", "row_id", "time", "endtime", F.expr(condition).alias(name)), (depends_on,), about=("cut", condition))


def cut_list_node(name: str, cuts: list[str]) -> Node:
    """All cuts and whether a row passes all."""
    return Node((name,), lambda spark, run_id, config, **inputs: all_of(positional_merge(list(inputs.values())), cuts, name), tuple(cuts), about=("cuts", name))


def overlap_node(name: str, depends_on: str, window: int | tuple[int, int], compute: Callable[..., DataFrame], fields: Iterable[str] = (), width: int | None = None) -> Node:
    """``compute(rows)`` of the rows with ``near``: an array of (time, endtime, fields) of all rows of the run that touch [time - left, endtime + right), by time.

    ``window`` is one number for both sides or (left, right), in ns and not
    negative.  The array is gathered by time bins as long as the window, so it
    reaches over any border between partitions.
    """
    left, right = window if isinstance(window, tuple) else (window, window)
    if left < 0 or right < 0:
        raise ValueError("a window is not negative")
    fields = list(fields)

    def run(spark, run_id, config, **inputs):
        rows = inputs[depends_on]
        base = rows.select("run_id", "row_id", (F.col("time") - left).alias("time"), (F.col("endtime") + right).alias("endtime"))
        pairs = overlap_pairs(rows.select(*dict.fromkeys(["run_id", "time", "endtime", *fields])), base, width or max(left + right, 1_000_000_000))
        near = pairs.groupBy(F.col("b_run_id").alias("run_id"), F.col("b_row_id").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"a_{c}").alias(c) for c in dict.fromkeys(["time", "endtime", *fields])]))).alias("near"))
        return compute(rows.join(near, ["run_id", "row_id"], "left"))

    return Node((name,), run, (depends_on,), about=("overlap", left, right, fields, f"{compute.__module__}.{compute.__qualname__}"))


def generator_node(name: str, depends_on: str, schema: str, generate: Callable, whole_run: bool = False) -> Node:
    """Many tables out of one: ``generate`` takes an iterator of pandas frames and yields others.

    It gets the rows partition by partition, or with ``whole_run`` all rows of a
    run in one call, by time; then a run has to fit one task's memory.
    """

    def run(spark, run_id, config, **inputs):
        rows = inputs[depends_on]
        if not whole_run:
            return rows.mapInPandas(generate, schema)

        def all_rows(pdf):
            import pandas as pd

            return pd.concat(list(generate(iter([pdf.sort_values("time", kind="stable")]))), ignore_index=True)

        return rows.groupBy("run_id").applyInPandas(all_rows, schema)

    return Node((name,), run, (depends_on,), about=("generator", schema, whole_run, f"{generate.__module__}.{generate.__qualname__}"))


@dataclass
class Context:
    spark: SparkSession
    stores: list[DatasetStore] = field(default_factory=list)
    config: dict = field(default_factory=dict)
    nodes: dict[str, Node] = field(default_factory=dict)
    runs: DataFrame | None = None
    superruns: dict[str, list] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()  # nodes and options that a stored lineage may differ in

    # registry
    def register(self, *nodes: Node) -> None:
        for node in nodes:
            known = {o.name: o for n in self.nodes.values() for o in n.options}
            for option in node.options:
                other = known.get(option.name)
                if other is not None and other.default is not _MISSING and option.default is not _MISSING and other.default != option.default and not set(node.provides) & set(self.nodes):
                    raise ValueError(f"two defaults of {option.name}")
            for old in {id(self.nodes[p]): self.nodes[p] for p in node.provides if p in self.nodes}.values():
                for p in old.provides:
                    self.nodes.pop(p, None)
            self.nodes |= dict.fromkeys(node.provides, node)

    def register_all(self, module) -> None:
        """Every node that is an attribute of ``module``."""
        self.register(*[x for x in vars(module).values() if isinstance(x, Node)])

    def register_cut_list(self, name: str, cuts: Iterable[Node]) -> None:
        """The cuts, and a node that combines them."""
        cuts = list(cuts)
        self.register(*cuts, cut_list_node(name, [c.provides[0] for c in cuts]))

    @classmethod
    def add_method(cls, f: Callable) -> None:
        """A function of a context becomes a method of all contexts."""
        setattr(cls, f.__name__, f)

    def drop_unreachable(self) -> None:
        """Deregister nodes that depend on what nothing provides, until none is left."""
        while gone := [p for p, n in self.nodes.items() if any(d not in self.nodes for d in n.depends_on)]:
            for p in gone:
                del self.nodes[p]

    def set_config(self, config: dict, mode: str = "update") -> None:
        if mode not in ("update", "setdefault", "replace"):
            raise ValueError(f"no mode {mode}")
        self.config = {**self.config, **config} if mode == "update" else {**config, **self.config} if mode == "setdefault" else dict(config)

    def purge_config(self) -> None:
        used = {o.name for n in self.nodes.values() for o in n.options}
        self.config = {k: v for k, v in self.config.items() if k in used}

    def derive(self, **config) -> Context:
        return Context(self.spark, list(self.stores), {**self.config, **config}, dict(self.nodes), self.runs, dict(self.superruns), self.ignored)

    def node(self, target: str) -> Node:
        if target not in self.nodes:
            raise KeyError(f"nothing provides {target}")
        return self.nodes[target]

    # introspection
    def dependencies(self, target: str) -> list[str]:
        """All that a target needs, what needs nothing first."""
        out: list[str] = []

        def walk(t: str, path: tuple[str, ...]) -> None:
            if t in path:
                raise ValueError(f"{t} depends on itself")
            for d in self.node(t).depends_on:
                walk(d, (*path, t))
                if d not in out:
                    out.append(d)

        walk(target, ())
        return out

    def levels(self) -> dict[str, int]:
        """How many steps each is from a root."""
        return {p: self._depth(p) for p in self.nodes}

    def _depth(self, target: str) -> int:
        return max((1 + self._depth(d) for d in self.node(target).depends_on), default=0)

    def roots(self) -> set[str]:
        return {d for n in self.nodes.values() for d in n.depends_on if d not in self.nodes} | {p for p, n in self.nodes.items() if not n.depends_on}

    def by_kind(self, targets: Iterable[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for t in targets:
            out.setdefault(self.node(t).kind, []).append(t)
        return out

    def show_config(self, target: str | None = None, pattern: str = "*") -> list[tuple]:
        """(option, default, current, provided table) of each option."""
        rows = {(o.name, p): o for p, n in self.nodes.items() if target is None or p in (target, *self.dependencies(target)) for o in n.options}
        return sorted((name, None if o.default is _MISSING else o.default, self.config.get(name), p) for (name, p), o in rows.items() if fnmatch.fnmatch(name, pattern))

    def search_field(self, pattern: str, run_id: str) -> list[tuple[str, str]]:
        return [(p, f.name) for p in self.nodes for f in self.get(run_id, p).schema.fields if fnmatch.fnmatch(f.name, pattern)]

    # identity
    def options(self, node: Node, run_id: str) -> dict:
        values = {o.name: o.value(self.config, run_id) for o in node.options}
        for o in node.options:  # a child's option takes the place of its parent's
            if o.parent:
                values[o.parent] = values.pop(o.name)
        return values

    def lineage(self, run_id: str, target: str) -> dict:
        out = {}
        for t in [*self.dependencies(target), target]:
            node = self.node(t)
            tracked = {o.parent or o.name for o in node.options if o.track}
            code = f"{node.compute.__module__}.{node.compute.__qualname__}"
            out[node.provides[-1]] = [code, node.version, {k: v for k, v in self.options(node, run_id).items() if k in tracked}, list(node.depends_on), list(node.about)]
        return out

    def key(self, run_id: str, target: str) -> tuple[str, str, str]:
        about = self.lineage(run_id, target)
        return run_id, target, short_hash([about, self.superruns[run_id]] if run_id in self.superruns else about)

    def is_stored(self, run_id: str, target: str) -> bool:
        return self._found(run_id, target) is not None

    def _found(self, run_id: str, target: str):
        key, about = self.key(run_id, target), self.lineage(run_id, target)
        for store in self.stores:
            if store.has(self.spark, key):
                return store, key
        if self.ignored:
            for store in self.stores:
                for other in store.keys(self.spark, run_id, target):
                    if self._strip(store.manifest(self.spark, other)["lineage"]) == self._strip(about):
                        return store, other
        return None

    def _strip(self, lineage: dict) -> dict:
        return {k: [*v[:2], {o: x for o, x in v[2].items() if o not in self.ignored}, *v[3:]] for k, v in lineage.items() if k not in self.ignored}

    # verbs
    def get(self, run_id: str, targets: str | list[str], save: Iterable[str] = (), selection=None, keep_columns=None, drop_columns=None, time_range=None, seconds_range=None, time_within=None, time_selection: str = "fully_contained", transform: Callable | None = None) -> DataFrame:
        """A lazy table of a target, or of several of one kind side by side."""
        names = [targets] if isinstance(targets, str) else list(targets)
        if len(self.by_kind(names)) > 1:
            raise ValueError("targets of several kinds; ask for them one by one")
        made: dict[str, DataFrame] = {}
        frames = [self._make(run_id, t, made, set(names), set(save)) for t in names]
        df = frames[0] if len(frames) == 1 else positional_merge(frames)
        if transform is not None:
            df = transform(df)
        span = absolute_range(self.run_start(run_id) if seconds_range is not None else 0, time_range, seconds_range, time_within)
        return apply_selection(df, selection, keep_columns, drop_columns, span, time_selection)

    def get_many(self, run_ids: Iterable[str], targets, ignore_errors: bool = False, **how) -> DataFrame:
        """Runs in order, one under the other."""
        out = None
        for run_id in sorted(run_ids):
            try:
                df = self.get(run_id, targets, **how)
            except (KeyError, ValueError):
                if ignore_errors:
                    continue
                raise
            out = df if out is None else out.unionByName(df)
        if out is None:
            raise ValueError("no run has the targets")
        return out

    def get_df(self, run_id: str, targets, **how):
        """A pandas frame."""
        return self.get(run_id, targets, **how).toPandas()

    def get_array(self, run_id: str, targets, **how):
        """An Arrow table."""
        return self.get(run_id, targets, **how).toArrow()

    def get_iter(self, run_id: str, targets, chunk: int, **how):
        """((start, end), lazy rows that begin there) for each range of ``chunk`` ns from the first row to the last; empty ranges too."""
        df = self.get(run_id, targets, **how)
        low, high = df.agg(F.min("time"), F.max("time")).first()
        while low is not None and low <= high:
            yield (low, low + chunk), df.where((F.col("time") >= low) & (F.col("time") < low + chunk))
            low += chunk

    def accumulate(self, run_id: str, targets, fields: list[str], others: list[str] | None = None, **how) -> DataFrame:
        """Sums over a target's rows; see the operator of that name."""
        return accumulate(self.get(run_id, targets, **how), fields, others)

    def data_info(self, run_id: str, target: str) -> list[tuple[str, str, str]]:
        """(column, type, comment) of a target."""
        return [(f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment", "")) for f in self.get(run_id, target).schema.fields]

    def make(self, run_id: str, target: str) -> None:
        """Store a target whose node is saved at all."""
        if not self.is_stored(run_id, target):
            self._make(run_id, target, {}, {target}, {target})

    def _make(self, run_id: str, target: str, made: dict, targets: set, save: set) -> DataFrame:
        if target in made:
            return made[target]
        found = self._found(run_id, target)
        if found is not None:
            made[target] = found[0].read(self.spark, found[1])
            return made[target]
        node = self.node(target)
        if run_id in self.superruns and not node.superruns:
            parts = None
            for sub in self.superruns[run_id]:
                name, span = (sub, None) if isinstance(sub, str) else (sub[0], (sub[1], sub[2]))
                part = apply_selection(self._make(name, target, {}, targets, save), time_range=span)
                parts = part if parts is None else parts.unionByName(part)
            made[target] = parts
        else:
            inputs = {d: self._make(run_id, d, made, targets, save) for d in node.depends_on}
            fetch = {o.parent or o.name: o.fetch for o in node.options if o.fetch is not None}
            config = {k: fetch[k](v) if k in fetch else v for k, v in self.options(node, run_id).items()}
            got = node.compute(self.spark, run_id, config, **inputs)
            made |= got if isinstance(got, dict) else {node.provides[0]: got}
        for p in node.provides:
            when = node.save
            wanted = when == SaveWhen.ALWAYS or when == SaveWhen.TARGET and p in targets or when == SaveWhen.EXPLICIT and p in save
            store = next((s for s in self.stores if s.takes(p)), None)
            if p in made and wanted and store is not None and not self.ignored:
                key = self.key(run_id, p)
                store.write(made[p], key, {"run_id": run_id, "data_type": p, "data_kind": node.kind, "lineage": self.lineage(run_id, p)})
                made[p] = store.read(self.spark, key)
        return made[target]

    # runs
    def run_start(self, run_id: str) -> int:
        if self.runs is not None:
            row = self.runs.where(F.col("name") == run_id).first()
            if row is not None:
                return row["start"]
        return 0

    def list_available(self, target: str) -> DataFrame:
        """Names of the runs whose target is stored under today's lineage.

        Keys are worked out on the driver, a row of the run table each; what is
        stored is listed once for each store.
        """
        keys = [(r[0], self.key(r[0], target)[2]) for r in self.runs.select("name").collect()]
        wanted = self.spark.createDataFrame(keys, "name string, hash string")
        found = None
        for store in self.stores:
            own = store.manifests(self.spark, "*", target).select(F.col("run_id").alias("name"), "hash")
            found = own if found is None else found.union(own)
        return wanted.join(found, ["name", "hash"], "left_semi").select("name") if found is not None else wanted.limit(0).select("name")

    def available_for_run(self, run_id: str) -> dict[str, bool]:
        return {t: self.is_stored(run_id, t) for t in self.nodes}

    def keys_for_runs(self, target: str, run_ids: Iterable[str]) -> list[tuple[str, str, str]]:
        return [self.key(r, target) for r in run_ids]

    def size_mb(self, run_id: str, target: str) -> float:
        found = self._found(run_id, target)
        return found[0].size_mb(self.spark, found[1]) if found else 0.0

    def compare_metadata(self, run_id: str, target: str, other: Context) -> dict[str, tuple]:
        """What differs in the lineage: (here, there) by data type."""
        a, b = self.lineage(run_id, target), other.lineage(run_id, target)
        return {t: (a.get(t), b.get(t)) for t in sorted(a.keys() | b.keys()) if a.get(t) != b.get(t)}

    def scan_runs(self, *tables: DataFrame) -> DataFrame:
        """The run tables one under the other as the context's; a name counts where it comes first."""
        out = None
        for table in tables:
            out = table if out is None else out.unionByName(table.join(out.select("name"), "name", "left_anti"), allowMissingColumns=True)
        self.runs = out
        return out

    def select_runs(self, modes=None, names=None, include_tags=None, exclude_tags=None, pattern: str = "fnmatch", available: Iterable[str] = ()) -> DataFrame:
        return select_runs(self.runs, modes, names, include_tags, exclude_tags, pattern, [self.list_available(t) for t in available])

    def define_run(self, name: str, parts: list) -> None:
        """A superrun of whole runs (ids) or of (id, start, end)."""
        if not name.startswith("_"):
            raise ValueError("the name of a superrun begins with _")
        self.superruns[name] = list(parts)

    def define_run_from(self, name: str, table: DataFrame) -> None:
        """A superrun of the intervals in a table."""
        rows = table.select("run_id", "time", "endtime").orderBy("run_id", "time").collect()
        self.define_run(name, [tuple(r) for r in rows])


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table of equally long columns, such as a calibration; rows in their order."""
    if len({len(c) for c in columns.values()}) > 1:
        raise ValueError("columns of different lengths")
    names = [f.split()[0] for f in schema.split(",")]
    return spark.createDataFrame(list(zip(*(columns[n] for n in names), strict=True)), schema)


def select_runs(runs: DataFrame, modes=None, names=None, include_tags=None, exclude_tags=None, pattern: str = "fnmatch", stored: Iterable[DataFrame] = ()) -> DataFrame:
    """Rows of (name, mode, tags: comma-separated) that match; exclusion beats inclusion, and a tag's leading _ counts for nothing."""
    rule = lambda p: f"^(?:{p})$" if pattern == "re" else fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?s:")
    many = lambda x: [x] if isinstance(x, str) else list(x)

    def any_of(column, patterns):
        hit = F.lit(False)
        for p in patterns:
            hit |= column.rlike(rule(p))
        return hit

    def tagged(patterns):
        strip = [re.sub("^_", "", p) for p in patterns]
        return F.exists(F.split("tags", ","), lambda t: any_of(F.regexp_replace(t, "^_", ""), strip))

    if modes is not None:
        runs = runs.where(any_of(F.col("mode"), many(modes)))
    if names is not None:
        runs = runs.where(any_of(F.col("name"), many(names)))
    if include_tags is not None:
        runs = runs.where(tagged(many(include_tags)))
    if exclude_tags is not None:
        runs = runs.where(~tagged(many(exclude_tags)))
    for names_there in stored:
        runs = runs.join(names_there, "name", "left_semi")
    return runs


def count_tags(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode(F.split("tags", ",")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
