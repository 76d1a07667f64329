"""Which symbols a call may reach, and what local names are: ranked joins, closures and a fixpoint over the fact tables.

A class is looked up by name in the file of whoever names it: declared there, imported, or the only one of that name in the project. A
method of a class is a function of that name within its range; of a chain of classes, the nearest that has it counts, else all interfaces
that declare it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_generics
from ..operators import graph, names
from .facts import Facts


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


class Resolution:
    """The tables that answer names: aliases and namespaces of a file, chains of classes, types of locals."""

    def __init__(self, facts: Facts) -> None:
        self.facts = facts
        self.spark = facts.symbols.sparkSession
        graph.shared_folder(self.spark)
        self.symbols = facts.symbols.checkpoint()
        s = self.symbols
        self.named = s.select(F.col("file").alias("t_file"), F.col("name").alias("t_name"), F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("start_byte").alias("t_start"))
        self.defaults = names.first_by(s.where("is_default_export"), ["file"], ["start_byte", "kind"], ["name", "start_byte"]).select(F.col("file").alias("d_file"), F.col("name").alias("d_name"))
        self.aliases, self.namespaces = self._scopes()
        self._classes()
        self.local_types = self._infer()

    # ---- imports

    def _chase(self, starts: DataFrame) -> DataFrame:
        """starts: file, name. Along re-exports in source order: the first file and name with a symbol (to_file, to_name). A trail is an
        array of ordinals, so the least one is what a search in depth would find first; of the trails to one place only the least goes on,
        so that the search ends in cycles and after as many rounds as the longest way has hops."""
        rx = self.facts.re_exports.where("kind != 'type' and resolved != '' and namespace = ''").withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("start_byte")))
        rx = rx.select(F.col("file").alias("r_file"), "resolved", "ord", "bindings").join(self.defaults, F.col("resolved") == F.col("d_file"), "left").checkpoint()
        place = ["file", "name", "at", "as"]
        front = starts.select("file", "name", F.col("file").alias("at"), F.col("name").alias("as"), F.array().cast("array<int>").alias("trail")).checkpoint()
        have = self.named.select(F.col("t_file").alias("at"), F.col("t_name").alias("as")).distinct().checkpoint()
        best = front
        while not front.isEmpty():
            step = front.join(rx, front["at"] == rx["r_file"])
            remote = F.get(F.filter("bindings", lambda b: (b["local_name"] == F.col("as")) & ~b["is_type_only"]), 0)["remote_name"]
            step = step.withColumn("_to", F.when(F.size("bindings") == 0, F.col("as")).when(remote == "default", F.col("d_name")).otherwise(remote)).where("_to is not null")
            step = step.groupBy("file", "name", F.col("resolved").alias("at"), F.col("_to").alias("as")).agg(F.min(F.concat("trail", F.array("ord"))).alias("trail"))
            step = step.join(best.withColumnRenamed("trail", "_old"), place, "left").where("_old is null or trail < _old").drop("_old").checkpoint()
            best = best.join(step.select(*place), place, "left_anti").unionByName(step).checkpoint()
            front = step.join(have, ["at", "as"], "left_anti").select(*place, "trail").checkpoint()
        found = best.join(have, ["at", "as"])
        return found.groupBy("file", "name").agg(F.min(F.struct("trail", "at", "as")).alias("_b")).select("file", "name", F.col("_b.at").alias("to_file"), F.col("_b.as").alias("to_name"))

    def _scopes(self) -> tuple[DataFrame, DataFrame]:
        value = self.facts.imports.where("kind != 'type' and resolved != ''")
        ids = value.where("namespace = ''").select("file", "resolved", "start_byte", F.posexplode("identifiers").alias("ord", "x")).where("not x.is_type_only")
        ids = ids.select("file", "resolved", "start_byte", "ord", F.col("x.local_name").alias("local"), F.col("x.remote_name").alias("remote"))
        spaces = self.facts.re_exports.where("namespace != '' and resolved != '' and kind != 'type'").select(F.col("file").alias("resolved"), F.col("namespace").alias("remote"), F.col("resolved").alias("space")).dropDuplicates(["resolved", "remote"])
        plain = ids.where("remote != 'default'").join(spaces, ["resolved", "remote"], "left")
        direct = plain.where("space is null").drop("space")
        have = self.named.select(F.col("t_file").alias("resolved"), F.col("t_name").alias("remote")).distinct().withColumn("_here", F.lit(True))
        direct = direct.join(have, ["resolved", "remote"], "left")
        chased = self._chase(direct.where("_here is null").select(F.col("resolved").alias("file"), F.col("remote").alias("name")).distinct())
        chased = chased.select(F.col("file").alias("resolved"), F.col("name").alias("remote"), "to_file", "to_name")
        direct = direct.join(chased, ["resolved", "remote"], "left").select("file", "local", "start_byte", "ord", F.coalesce("to_file", "resolved").alias("t_file"), F.coalesce("to_name", "remote").alias("t_name"))
        default = ids.where("remote = 'default'").join(self.defaults, F.col("resolved") == F.col("d_file")).select("file", "local", "start_byte", "ord", F.col("resolved").alias("t_file"), F.col("d_name").alias("t_name"))
        every = direct.unionByName(default)
        aliases = every.groupBy("file", "local").agg(F.max(F.struct("start_byte", "ord", "t_file", "t_name")).alias("_b")).select("file", "local", "_b.t_file", "_b.t_name")
        space = plain.where("space is not null").select("file", F.col("local").alias("local"), F.col("space").alias("t_file"), "start_byte")
        space = space.unionByName(value.where("namespace != ''").select("file", F.col("namespace").alias("local"), F.col("resolved").alias("t_file"), "start_byte"))
        return aliases.checkpoint(), space.groupBy("file", "local").agg(F.max_by("t_file", "start_byte").alias("t_file")).checkpoint()

    def find(self, refs: DataFrame, kind: str) -> DataFrame:
        """refs: ref, file, name. ref, target: the symbol of that kind that name means in file."""
        own = self.named.where(F.col("t_kind") == kind)
        earliest = own.groupBy("t_file", "t_name").agg(F.min_by("target", "t_start").alias("target"))
        here = refs.join(earliest, (refs["file"] == earliest["t_file"]) & (refs["name"] == earliest["t_name"])).select("ref", "target")
        named = refs.join(self.aliases.withColumnRenamed("local", "name"), ["file", "name"]).join(earliest, ["t_file", "t_name"]).select("ref", "target")
        unique = names.unique_by(own, ["t_name"], "target")
        alone = refs.join(unique, refs["name"] == unique["t_name"]).select("ref", "target")
        return names.resolve_ranked(refs.select("ref").distinct(), "ref", [here, named, alone]).where("target is not null").select("ref", "target")

    # ---- classes and interfaces

    def _classes(self) -> None:
        s = self.symbols
        cls = s.where("kind = 'class'")
        parents = cls.select(F.col("id").alias("ref"), "file", F.get("extends", F.lit(0)).alias("name")).where("name is not null and name != ''")
        parent = self.find(parents, "class").select(F.col("ref").alias("node"), F.col("target").alias("parent")).checkpoint()
        self.parent = parent.select(F.col("node").alias("class_id"), "parent")
        self.chain = graph.chain_closure(cls.select(F.col("id").alias("node")).join(parent, "node", "left")).select(F.col("node").alias("class_id"), F.col("ancestor"), "depth").checkpoint()
        fn = s.where("kind = 'function'").select(F.col("file").alias("f_file"), F.col("name").alias("method"), F.col("id").alias("target"), F.col("start_byte").alias("a"), F.col("end_byte").alias("b"), F.col("return_type"))
        span = cls.select(F.col("id").alias("ancestor"), "file", "start_byte", "end_byte")
        self.methods = fn.join(span, (fn["f_file"] == span["file"]) & (span["start_byte"] <= fn["a"]) & (fn["b"] <= span["end_byte"])).select("ancestor", "method", "target", "a", "return_type", F.col("f_file").alias("m_file")).checkpoint()
        iface = s.where("kind = 'interface'")
        named = cls.select("id", "file", F.explode("implements").alias("name")).unionByName(iface.select("id", "file", F.explode("extends").alias("name")))
        links = self.find(named.select(F.concat_ws("|", "id", "name").alias("ref"), "file", "name").distinct(), "interface").join(named.select("id", F.concat_ws("|", "id", "name").alias("ref")), "ref").select(F.col("id").alias("src"), F.col("target").alias("dst")).distinct().checkpoint()
        reached = iface.select(F.col("id").alias("node"), F.col("id").alias("iface"), F.lit(0).alias("depth")).checkpoint()
        front, depth = reached, 0
        while True:
            depth += 1
            front = front.drop("depth").join(links, front["iface"] == links["src"]).select("node", F.col("dst").alias("iface")).distinct().join(reached, ["node", "iface"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
            if front.isEmpty():
                break
            reached = reached.unionByName(front).checkpoint()
        self.iface_closure = reached
        up = self.chain.join(links, self.chain["ancestor"] == links["src"]).select("class_id", F.col("dst").alias("node")).distinct()
        declares = iface.select(F.col("id").alias("iface"), F.explode("methods").alias("m")).select("iface", F.col("m.name").alias("method")).distinct()
        self.iface_methods = up.join(self.iface_closure, "node").select("class_id", "iface").distinct().join(declares, "iface").select("class_id", "method", F.col("iface").alias("target")).distinct().checkpoint()
        props = cls.select(F.col("id").alias("ancestor"), "file", F.posexplode("properties").alias("ord", "p")).select("ancestor", F.col("file").alias("p_file"), "ord", F.col("p.name").alias("property"), F.col("p.type").alias("p_type"))
        near = self.chain.join(props, "ancestor")
        self.class_props = _first(near, ["class_id", "property"], ["depth", "ord"]).select("class_id", "property", "p_type", "p_file").checkpoint()
        iprops = iface.select(F.col("id").alias("iface"), F.posexplode("properties").alias("ord", "p")).select("iface", "ord", F.col("p.name").alias("property"), F.col("p.type").alias("p_type"))
        self.iface_props = _first(self.iface_closure.join(iprops, "iface"), ["node", "property"], ["depth", "iface", "ord"]).select(F.col("node").alias("iface_id"), "property", "p_type").checkpoint()

    def chain_methods(self, refs: DataFrame) -> DataFrame:
        """refs: ref, class_id, method. ref, target, a, return_type, m_file of the nearest class in the chain that has the method."""
        near = refs.join(self.chain, "class_id").join(self.methods, ["ancestor", "method"])
        least = near.groupBy("ref").agg(F.min("depth").alias("depth"))
        return near.join(least, ["ref", "depth"]).select("ref", "target", "a", "return_type", "m_file")

    def members(self, refs: DataFrame) -> DataFrame:
        """ref, target: methods of the chain, else of interfaces."""
        own = self.chain_methods(refs).select("ref", "target")
        other = refs.join(self.iface_methods, ["class_id", "method"]).select("ref", "target").join(own.select("ref"), "ref", "left_anti")
        return own.unionByName(other).distinct()

    # ---- types of locals

    def _functions_named(self, refs: DataFrame, need_type: bool) -> DataFrame:
        """refs: ref, file, name. The first function of that name in file, else behind its alias: ref, target, return_type, m_file."""
        fn = self.symbols.where("kind = 'function'")
        fn = fn.where("return_type != ''") if need_type else fn
        own = names.first_by(fn, ["file", "name"], ["start_byte", "id"], ["id", "return_type", "start_byte"])
        here = refs.join(own, ["file", "name"]).select("ref", F.col("id").alias("target"), "return_type", F.col("file").alias("m_file"))
        far = own.select(F.col("file").alias("t_file"), F.col("name").alias("t_name"), F.col("id").alias("target"), "return_type")
        away = refs.join(self.aliases.withColumnRenamed("local", "name"), ["file", "name"]).join(far, ["t_file", "t_name"]).select("ref", "target", "return_type", F.col("t_file").alias("m_file"))
        return here.unionByName(away.join(here.select("ref"), "ref", "left_anti"))

    def _infer(self) -> DataFrame:
        """symbol_id, file, local, type, origin: bindings get types until none gets a new one. A local that has one keeps it."""
        known = self.facts.local_types.select("symbol_id", "file", "local", "type", "origin").checkpoint()
        bound = self.facts.local_bindings.withColumn("ref", F.concat_ws("|", "symbol_id", "local", "form", "receiver", "callee", "property")).checkpoint()
        while True:
            todo = bound.join(known.select("symbol_id", "local"), ["symbol_id", "local"], "left_anti").checkpoint()
            if todo.isEmpty():
                break
            free = todo.where("receiver = ''")
            called = self._functions_named(free.where("form = 'call'").select("ref", "file", F.col("callee").alias("name")), True).select("ref", F.col("return_type").alias("raw"))
            receivers = todo.where("receiver != ''").join(known.select("symbol_id", F.col("local").alias("receiver"), F.col("type").alias("name")), ["symbol_id", "receiver"])
            classes = self.find(receivers.select("ref", "file", "name"), "class").withColumnRenamed("target", "class_id")
            on = receivers.join(classes, "ref").select("ref", "class_id", F.col("callee").alias("method"), "form", "property")
            typed = on.where("form = 'method'").join(self.chain, "class_id").join(self.methods, ["ancestor", "method"]).where("return_type != ''")
            returned = typed.groupBy("ref").agg(F.min_by("return_type", F.struct("depth", "a")).alias("raw"))
            sources = self._functions_named(free.where("form = 'destructure'").select("ref", "file", F.col("callee").alias("name")), False)
            own = self.chain_methods(on.where("form = 'destructure'").select("ref", "class_id", "method"))
            sources = sources.unionByName(_first(own, ["ref"], ["a"]).select("ref", "target", "return_type", "m_file")).join(todo.select("ref", "property"), "ref")
            based = sources.where("return_type != ''").select("ref", "property", F.col("m_file").alias("file"), strip_generics(F.col("return_type")).alias("name"))
            of_class = based.join(self.find(based.select("ref", "file", "name"), "class"), "ref").join(self.class_props.withColumnRenamed("class_id", "target"), ["target", "property"]).select("ref", F.col("p_type").alias("raw"))
            of_iface = based.join(self.find(based.select("ref", "file", "name"), "interface"), "ref").join(self.iface_props.withColumnRenamed("iface_id", "target"), ["target", "property"]).select("ref", F.col("p_type").alias("raw"))
            inline = sources.join(self.facts.inline_returns.withColumnRenamed("symbol_id", "target"), ["target", "property"])
            inline = inline.join(known.select(F.col("symbol_id").alias("target"), F.col("local").alias("local_var"), "type"), ["target", "local_var"], "left").select("ref", F.when(F.col("new_type") != "", F.col("new_type")).otherwise(F.col("type")).alias("raw"))
            ranked = [x.where("raw is not null and raw != ''").select("ref", F.lit(k).alias("k"), "raw") for k, x in enumerate((called, returned, of_class, of_iface, inline))]
            best = reduce(DataFrame.unionByName, ranked).groupBy("ref").agg(F.min(F.struct("k", "raw")).alias("b"))
            origin = F.when(F.col("form") == "call", "inferred:call-return").when(F.col("form") == "method", "inferred:method-return").otherwise("inferred:destructure")
            fresh = todo.join(best, "ref").select("symbol_id", "file", "local", strip_generics(F.col("b.raw")).alias("type"), origin.alias("origin"), F.when(F.col("form") == "call", 0).when(F.col("form") == "method", 1).otherwise(2).alias("o")).where("type != ''")
            fresh = _first(fresh, ["symbol_id", "local"], ["o", "type"]).drop("o").checkpoint()
            if fresh.isEmpty():
                break
            known = known.unionByName(fresh).checkpoint()
        return known

    # ---- calls

    def calls(self) -> DataFrame:
        """call_id, caller_id, target_id: a call may have several targets, or none."""
        c = self.facts.calls.withColumn("ref", F.col("call_id")).checkpoint()
        spans = self.symbols.where("kind = 'class'").select(F.col("id").alias("class_id"), "file", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
        asking = c.where("receiver in ('this', 'super') or receiver like 'this.%'").select("ref", "file", "start_byte", "end_byte")
        inside = asking.join(spans, "file").where("s <= start_byte and end_byte <= e").groupBy("ref").agg(F.min_by("class_id", F.struct(F.col("e") - F.col("s"), "class_id")).alias("class_id")).checkpoint()
        named = self.named
        plain = c.where("receiver = '' and callee != ''")
        here = plain.join(named, (plain["file"] == named["t_file"]) & (plain["callee"] == named["t_name"])).select("ref", "target")
        away = plain.join(here.select("ref"), "ref", "left_anti").join(self.aliases.withColumnRenamed("local", "callee"), ["file", "callee"]).join(named, ["t_file", "t_name"]).select("ref", "target")
        this = self.members(c.where("receiver = 'this' and callee != ''").join(inside, "ref").select("ref", "class_id", F.col("callee").alias("method")))
        above = inside.join(self.parent, "class_id").select("ref", F.col("parent").alias("class_id"))
        sup = self.members(c.where("receiver = 'super' and callee != ''").join(above, "ref").select("ref", "class_id", F.col("callee").alias("method")))
        built = self.chain_methods(c.where("receiver = 'super' and callee = ''").join(above, "ref").select("ref", "class_id", F.lit("constructor").alias("method"))).select("ref", "target")
        fields = c.where("receiver like 'this.%' and callee != ''").join(inside, "ref").select("ref", "class_id", F.col("callee").alias("method"), F.split(F.substring("receiver", 6, 1 << 20), r"\.").alias("path")).checkpoint()
        longest = fields.agg(F.max(F.size("path"))).first()[0] or 0
        done = fields.where("false").select("ref", "class_id", "method")
        for k in range(longest):
            step = fields.withColumn("property", F.get("path", F.lit(k))).join(self.class_props, ["class_id", "property"]).select("ref", "method", "path", F.col("p_file").alias("file"), strip_generics(F.col("p_type")).alias("name"))
            fields = step.join(self.find(step.select("ref", "file", "name"), "class"), "ref").select("ref", F.col("target").alias("class_id"), "method", "path").checkpoint()
            done = done.unionByName(fields.where(F.size("path") == k + 1).select("ref", "class_id", "method"))
        chained = self.members(done)
        member = c.where("receiver not in ('', 'this', 'super') and callee != ''")
        space = member.join(self.namespaces.withColumnRenamed("local", "receiver"), ["file", "receiver"]).join(named.withColumnRenamed("t_name", "callee"), ["t_file", "callee"]).select("ref", "target")
        local = member.join(self.local_types.select(F.col("symbol_id").alias("caller_id"), F.col("local").alias("receiver"), F.col("type").alias("name")), ["caller_id", "receiver"]).select("ref", "file", "name", F.col("callee").alias("method"))
        local = self.members(local.join(self.find(local.select("ref", "file", "name"), "class"), "ref").select("ref", F.col("target").alias("class_id"), "method"))
        static = member.select("ref", "file", F.col("receiver").alias("name"), F.col("callee").alias("method"))
        static = self.chain_methods(static.join(self.find(static.select("ref", "file", "name"), "class"), "ref").select("ref", F.col("target").alias("class_id"), "method")).select("ref", "target")
        every = reduce(DataFrame.unionByName, (x.select("ref", "target", F.lit(k).alias("rank")) for k, x in enumerate((built, here, away, this, sup, chained, space, local, static))))
        least = every.groupBy("ref").agg(F.min("rank").alias("rank"))
        kept = every.join(least, ["ref", "rank"]).select("ref", "target").distinct()
        return c.join(kept, "ref").select("call_id", "caller_id", F.col("target").alias("target_id"))
