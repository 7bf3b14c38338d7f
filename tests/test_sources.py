import json

from factline.operators import resolve
import pytest

from factline.sources import folder, manifest, python_source, sites
from factline.streaming import events
from pyspark.sql import functions as F


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_folder_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in {"src/a.py": "x = 1\n", "src/b.py": "a\0b", "node_modules/c.py": "y", "d.txt": "no", "secrets.py": "z", "src/big.py": "#" * 2000, "src/skip.py": "1"}.items():
        (tmp_path / name).write_text(text)
    found = folder.scan(spark, str(tmp_path), ignore=["skip.py"], most_bytes=1000)
    assert values(found, "path", "language", "content") == [("src/a.py", "python", "x = 1\n")]
    (tmp_path / "c.json").write_text(json.dumps({"tasks": [{"id": "t", "repo": "r", "category": "c", "required": [{"kind": "symbol", "name": "n"}]}]}))
    assert folder.ground_truth(spark, str(tmp_path / "c.json")).select("id", "item.name").first() == ("t", "n")


def test_bounded_reads(spark):
    text = "é" * 50 + "\n" + "ü" * 50
    got = spark.range(1).select(folder.bounded(F.lit(text), 61).alias("t"), folder.byte_range(F.lit(text), F.lit(2), F.lit(4)).alias("r")).first()
    assert got["t"].startswith("é" * 18) and got["t"].endswith("ü" * 12) and "�" not in got["t"] and got["r"] == "éé"


def test_python_symbols():
    code = '"""Doc."""\nLIMIT = 3\nclass A:\n    """An A."""\n    def f(self):\n        return 1\n    def f(self):\n        return 2\n\nasync def g():\n    """Does g."""\n'
    got = python_source.extract("m.py", code, "python")
    assert [(s[1], s[4]) for s in got] == [("m.py::LIMIT#constant", "constant"), ("m.py::A#class", "class"), ("m.py::A.f#method~1", "method"), ("m.py::A.f#method~2", "method"), ("m.py::g#function", "function")]
    assert field(got[-1], "docstring") == "Does g." and python_source.extract("bad.py", "def (", "python") == []


def field(symbol, *names):
    found = dict(zip(python_source.NAMES, symbol, strict=True))
    return found[names[0]] if len(names) == 1 else tuple(found[n] for n in names)


def test_python_symbols_nest_and_keep_their_bytes():
    code = "if 1:\n    _MOST: int = 3\n    a_b = 4\n\n@é.wraps(x)\n@two\nasync def f(a,\n            b=1):  # é\n    x = 1\n    'Not first.'\n    def inner():\n        pass\n    class K:\n        def m(self): return 1\n"
    got = python_source.extract("m.py", code, "python")
    assert [field(s, "qualified_name", "kind", "parent") for s in got] == [
        ("_MOST", "constant", ""), ("f", "function", ""), ("f.inner", "function", "m.py::f#function"), ("f.K", "class", "m.py::f#function"), ("f.K.m", "method", "m.py::f.K#class")
    ]
    assert field(got[1], "decorators", "docstring", "line") == (["@é.wraps(x)", "@two"], "Not first.", 7)
    assert field(got[1], "signature").startswith("async def f(a,\n            b=1)")
    for s in got:
        a, n = field(s, "byte_offset", "byte_length")
        assert code.encode()[a : a + n].decode().split("(")[0].split(":")[0].split()[-1] == field(s, "name")


DECLARED = {
    "go": ("// S holds é.\ntype S struct {\n\tn int // func Not() {\n}\n\nfunc (s *S) Close() error {\n\tif x := `}`; x != \"\" {\n\t}\n\treturn nil\n}\n", [("S", "type", 2, 4, "S holds é."), ("Close", "method", 6, 10, "")]),
    "rust": ("#[derive(Debug)]\npub struct P;\nimpl<'a> P {\n    /// Runs.\n    pub async fn run(&'a self) -> [u8; 2] { let c = '}'; x }\n}\ntrait T {\n    fn must(&self);\n    fn may(&self) { }\n}\n", [("P", "type", 2, 2, ""), ("run", "function", 5, 5, "Runs."), ("T", "type", 7, 10, ""), ("T.may", "method", 9, 9, "")]),
    "typescript": ("/** A store. */\nclass A<T> {\n  @log('x')\n  async save(a: number): Promise<void> {\n    if (a) { go(/}/) }\n  }\n}\nexport const f = (x: string): string => {\n  function g() {}\n  return `${x}}`\n}\nenum E { X }\ntype U = 'a' |\n  'b';\n", [("A", "class", 2, 7, "A store."), ("A.save", "method", 4, 6, ""), ("f", "function", 8, 11, ""), ("f.g", "function", 9, 9, ""), ("E", "type", 12, 12, ""), ("U", "type", 13, 14, "")]),
    "java": ("interface Shape {\n  double area();\n}\nfinal class Box<T extends Shape> implements Shape {\n  private int n = size(2);\n  /* Makes one. */\n  Box(int n) { this.n = n; }\n  @Override public double area() {\n    if (n > 1) { return call(n); }\n    return 0;\n  }\n}\n", [("Shape", "type", 1, 3, ""), ("Shape.area", "method", 2, 2, ""), ("Box", "class", 4, 12, ""), ("Box.Box", "method", 7, 7, "Makes one."), ("Box.area", "method", 8, 11, "")]),
    "php": ("<?php\n# Adds.\nfunction add($a) { return \"{$a}\"; }\nabstract class C {\n  abstract protected function must();\n  public static function may(): int { return 1; }\n}\n", [("add", "function", 3, 3, "# Adds."), ("C", "class", 4, 7, ""), ("C.must", "method", 5, 5, ""), ("C.may", "method", 6, 6, "")]),
    "c": ("struct node *head;\nstruct node {\n  int n;\n};\nstatic int *find(struct node *n, int (*f)(int)) {\n  while (n) { f(1); }\n  return 0;\n}\n", [("node", "type", 2, 4, ""), ("*find(struct node *n, int (*f)(int))", "function", 5, 8, "")]),
    "cpp": ("namespace a {\nclass B : public C {\n public:\n  // Gets.\n  int get() const { return 1; }\n};\n}\nint a::B::put(int x) {\n  return x;\n}\n", [("a", "type", 1, 7, ""), ("a.B", "class", 2, 6, ""), ("a.B.get() const", "method", 5, 5, "Gets."), ("a::B::put(int x)", "function", 8, 10, "")]),
    "ruby": ("module M\n  class A\n    def self.make(x)\n      return 1 if x\n      x.each do |y|\n        puts \"end\"\n      end\n    end\n    def done? = true\n  end\nend\n", [("M", "type", 1, 11, ""), ("M.A", "class", 2, 10, ""), ("M.A.make", "method", 3, 8, ""), ("M.A.done?", "method", 9, 9, "")]),
    "kotlin": ("// Keeps.\nobject Keep {\n  fun <T> String.of(x: T): Int = when (x) {\n    else -> 1\n  }\n  private suspend fun go() {\n    run { }\n  }\n}\nfun one() = 1\n", [("Keep", "class", 2, 9, "Keeps."), ("Keep.of", "method", 3, 5, ""), ("Keep.go", "method", 6, 8, ""), ("one", "function", 10, 10, "")]),
    "swift": ("protocol P {\n  func must()\n}\nfinal class A: P {\n  /// Must.\n  public func must() {\n    let s = \"}\"\n  }\n}\n", [("P", "type", 1, 3, ""), ("A", "class", 4, 9, ""), ("A.must", "method", 6, 8, "Must.")]),
    "lua": ("function M.open(a)\n  for i = 1, 2 do if a then x() elseif b then y() end end\n  repeat z() until a\n  local function inner() return function() end end\nend\n--[[ function no() ]]\nlocal function shut() end\n", [("M.open", "function", 1, 5, ""), ("M.open.inner", "function", 4, 4, ""), ("shut", "function", 7, 7, "--[[ function no() ]]")]),
}


@pytest.mark.parametrize("language", DECLARED)
def test_declarations_nest(language):
    code, want = DECLARED[language]
    got = python_source.extract("f", code, language)
    assert [field(s, "qualified_name", "kind", "line", "end_line", "docstring") for s in got] == want
    assert python_source.extract("f", None, language) == [] and isinstance(python_source.extract("f", code[: len(code) // 2], language), list)


def test_decorators_of_declarations():
    assert field(python_source.extract("f", DECLARED["rust"][0], "rust")[0], "decorators") == ["#[derive(Debug)]"]
    assert field(python_source.extract("f", DECLARED["typescript"][0], "typescript")[1], "decorators") == ["@log('x')"]


def test_declarations():
    assert [s[2] for s in python_source.extract("a.go", "func Open() {\n}\nfunc (s *S) Close() {\n}\ntype S struct {\n", "go")] == ["Open", "Close", "S"]
    assert [s[2] for s in python_source.extract("a.ts", "export class A {\n}\nexport const f = () => 1\nfunction g() {}\n", "typescript")] == ["A", "f", "g"]
    assert [s[2] for s in python_source.extract("a.rs", "pub fn run() {}\nstruct P;\n", "rust")] == ["run", "P"]


MANIFEST = """
fx_version 'cerulean' -- server_script 'no.lua'
game "gta5"
client_scripts { 'client/*.lua', '@other/init.lua' }
server_script('server/main.lua')
shared_script 'shared/*.lua'
exports { 'getThing' }
--[[ dependency 'commented' ]]
dependency 'base'
"""


def test_manifests_and_configs(spark):
    assert set(manifest.directives(MANIFEST)) == {("version", "", "cerulean"), ("game", "", "gta5"), ("script", "client", "client/*.lua"), ("dependency", "", "other"), ("script", "server", "server/main.lua"), ("script", "shared", "shared/*.lua"), ("export", "client", "getThing"), ("dependency", "", "base")}
    files = spark.createDataFrame(
        [("res/[core]/a/fxmanifest.lua", MANIFEST), ("res/b/fxmanifest.lua", ""), ("res/x/dup/fxmanifest.lua", ""), ("res/y/dup/fxmanifest.lua", ""), ("server.cfg", "ensure a # yes\n// ensure z\nexec more.cfg\nstop b\nensure dup"), ("more.cfg", "start b\nexec server.cfg\n; ensure q")],
        "path string, content string",
    )
    assert values(manifest.resources(files), "name", "group", "duplicate") == [("a", "core", False), ("b", "", False), ("dup", "", True), ("dup", "", True)]
    commands = manifest.config_commands(files, "server.cfg")
    assert [tuple(r) for r in commands.orderBy("seq").collect()] == [(1, "ensure", "a"), (2, "start", "b"), (3, "stop", "b"), (4, "ensure", "dup")]
    assert values(manifest.states(commands, manifest.resources(files)), "name", "state") == [("a", "enabled"), ("b", "disabled"), ("dup", "unknown"), ("dup", "unknown")]
    assert folder.mode(files).first()["mode"] == "workspace"
    paths = spark.createDataFrame([("client/x.lua",), ("server/main.lua",), ("shared/y.lua",), ("z.lua",)], "path string")
    sides = manifest.classify(paths, [("client", "client/*.lua"), ("server", "server/main.lua"), ("shared", "shared/*.lua")])
    assert values(sides, "path", "side") == [("client/x.lua", "client"), ("server/main.lua", "server"), ("shared/y.lua", "shared"), ("z.lua", "unknown")]


CLIENT = """
-- TriggerServerEvent('commented')
TriggerServerEvent('shop:buy', 1)
TriggerServerEvent('shop:local')
TriggerEvent(name)
local p = exports.qbx_core:GetPlayer(1)
exports['bank']:Pay()
"""
SERVER = """
RegisterNetEvent('shop:buy')
AddEventHandler('shop:buy', function() end)
AddEventHandler('shop:local', function() end)
exports('Pay', function() end)
"""


def facts(spark):
    files = spark.createDataFrame([("r/shop/c.lua", CLIENT), ("r/bank/s.lua", SERVER)], "path string, content string")
    resources = spark.createDataFrame([("r/shop", "shop"), ("r/bank", "bank")], "resource_path string, name string")
    found = resolve.owned(sites.sites_of(files), resources)
    return found.withColumn("side", F.when(F.col("path").endswith("c.lua"), "client").otherwise("server")), resources


def test_events_cross_sides_only_if_registered(spark):
    found, _ = facts(spark)
    assert values(resolve.event_edges(found), "name", "from_path", "to_path") == [("shop:buy", "r/shop/c.lua", "r/bank/s.lua")]
    assert found.filter("kind = 'event_trigger' AND dynamic").count() == 1
    assert values(found.filter("kind = 'framework_call'"), "name", "target") == [("player_lookup", "qbx_core")]


def test_exports_need_a_fitting_provider(spark):
    found, resources = facts(spark)
    got = values(resolve.export_edges(found, resources), "target", "name", "status")
    assert got == [("bank", "Pay", "local_api_missing"), ("qbx_core", "GetPlayer", "external_unverified")]
    both = resolve.export_edges(found.withColumn("side", F.lit("shared")), resources)
    assert ("bank", "Pay", "local_verified") in values(both, "target", "name", "status")
    twice = resources.unionByName(spark.createDataFrame([("r/else/bank", "bank")], "resource_path string, name string"))
    assert ("bank", "Pay", "local_ambiguous") in values(resolve.export_edges(found, twice), "target", "name", "status")


LINEAGE = """
local Core = exports['qb-core']:GetCoreObject()
local other = exports.es_extended:getSharedObject()
function a()
  Core.Functions.GetPlayer(1)
end
function b(Core)
  Core.Functions.GetPlayer(1)
end
if x then other = nil elseif y then z() end
other.getPlayer()
"""


def test_objects_keep_their_origin():
    got = [(s[1], s[2], s[4]) for s in sites.object_calls(LINEAGE)]
    assert got == [("player_lookup", "qb-core", False), ("GetPlayer", "", True), ("getPlayer", "", True)]


def test_callbacks_cross_sides(spark):
    rows = [("a", "client", "callback_call", "cb", False), ("b", "server", "callback_definition", "cb", False), ("c", "client", "callback_definition", "cb", False)]
    f = spark.createDataFrame(rows, "path string, side string, kind string, name string, dynamic boolean")
    assert values(resolve.callback_edges(f), "from_path", "to_path") == [("a", "b")]


def test_tasks(spark):
    from factline.plans import planning

    def read(text, *columns):
        return tuple(spark.range(1).select(*[c(F.lit(text)).alias(str(i)) for i, c in enumerate(columns)]).first())

    assert read("who calls `openFile`?", planning.task_class, planning.trace_direction, planning.quoted) == ("relationship_trace", "incoming", ["openFile"])
    assert read("review the architecture and fix it", planning.task_class, planning.confidence) == ("broad_unknown", "medium")
    assert read("fix user.save in the store", planning.task_class, planning.task_terms, planning.strong_terms) == ("localized_change", ["user.save", "store"], ["user.save"])
    assert read("hello there", planning.task_class, planning.confidence, planning.expansion_depth) == ("broad_unknown", "low", 1)


def test_imports_and_calls_resolve_once(spark):
    code = {"a/x.ts": "import { save } from './store'\nimport { no } from './absent'\nfunction f() { save(); twice(); mine(); }\nfunction mine() {}\n", "a/store.ts": "export function save() {}\n", "a/p.ts": "function twice() {}\n", "a/q.ts": "function twice() {}\n"}
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    found = sites.sites_of(files)
    imports = resolve.import_files(found, files)
    assert values(imports.na.fill("-"), "target", "file") == [("./absent", "-"), ("./store", "a/store.ts")]
    calls = resolve.call_edges(found, python_source.symbols_of(files), imports)
    got = {r["name"]: r["symbol_id"] for r in calls.filter("path = 'a/x.ts'").collect()}
    assert got["save"] == "a/store.ts::save#function" and got["mine"] == "a/x.ts::mine#function" and got["twice"] is None


def stream(spark, tmp_path, rows, schema):
    where = tmp_path / "in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(where))
    return spark.readStream.schema(schema).parquet(str(where))


def seconds(n):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def test_debounce(spark, tmp_path):
    rows = [("w", seconds(0), "a"), ("w", seconds(0.4), "b"), ("w", seconds(1.0), "a"), ("w", seconds(99), "z")]
    schema = "watch string, ts timestamp, path string"
    batch = events.debounced(spark.createDataFrame(rows, schema), ["watch"], "ts")
    assert values(batch, "n", "n_paths") == [(1, 1), (1, 1), (2, 2)]
    live = events.debounced(stream(spark, tmp_path, rows, schema).withWatermark("ts", "1 second"), ["watch"], "ts")
    q = live.writeStream.format("memory").queryName("debounced").trigger(availableNow=True).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["n_paths"]) for r in spark.table("debounced").collect()) == [(1, 1), (2, 2)]  # the last is still open


def test_throttle_on_batch_and_stream(spark, tmp_path):
    rows = [("t", seconds(n * 6)) for n in range(10)] + [("t", seconds(114)), ("u", seconds(0))]
    schema = "tool string, ts timestamp"
    df = spark.createDataFrame(rows, schema)
    hard = [r["level"] for r in events.throttled(df.filter("tool = 't'"), "tool", "ts", 60, hard=True).orderBy("ts").collect()]
    assert hard[:10] == ["normal"] * 3 + ["reduced"] * 5 + ["blocked"] * 2 and hard[10] == "normal"
    assert "warned" in {r["level"] for r in events.throttled(df, "tool", "ts", 60).collect()}
    live = events.throttle_stream(stream(spark, tmp_path, rows, schema), "tool", "ts", 60, hard=True)
    q = live.writeStream.format("memory").queryName("throttled").trigger(availableNow=True).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = values(events.throttled(df, "tool", "ts", 60, hard=True), "tool", "ts", "n", "level")
    assert values(spark.table("throttled"), "tool", "ts", "n", "level") == want


def test_incremental_refresh_equals_a_full_one(spark, tmp_path):
    rows = [(1, "a", "write"), (2, "b", "write"), (3, "a", "remove"), (4, "c", "write")]
    schema = "seq long, path string, action string"
    kept = {}

    def apply(batch, _):
        for r in events.last_actions(batch, "path", "action", "seq").collect():
            kept.pop(r["path"], None) if r["action"] == "remove" else kept.__setitem__(r["path"], True)

    q = events.refresh(stream(spark, tmp_path, rows, schema), apply, str(tmp_path / "cp"))
    q.awaitTermination(120)
    full = events.last_actions(spark.createDataFrame(rows, schema), "path", "action", "seq").filter("action = 'write'")
    assert sorted(kept) == [r["path"] for r in full.orderBy("path").collect()]
    assert events.unwatch(spark, "refresh") is False and events.watches(spark) == []
