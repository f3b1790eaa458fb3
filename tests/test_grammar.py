"""Declarations, facts and the call graph of sources that are hard to read."""

from __future__ import annotations

import pytest

from sparkloom.operators import mapping
from sparkloom.operators.extract import extract, extract_source, facts, facts_source, register

TS = r"""
import { A } from 'x'
export namespace N { export class Inner { go() { return 1 } } }
@Injectable()
export default class Big<T extends Map<string, T>> extends Base<T> implements I {
  private static readonly re = /[}]\/"/g
  name = `a ${ {x: "}"}.x } }`
  count: number = 3
  constructor(private readonly items: ItemService, @Inject('q') private q: Queue<string>) { super() }
  @Get({ path: ':id', version: '1' }) @UseGuards(G)
  async one<K extends keyof T>(id: string): Promise<{ a: K }> { return this.items.find(id.replace(/\}/g, "")) }
  two(a = {b: 1}): void
  two(a: any) { if (x) /}/.test(a); return a / 2 / 3 }
  @Post() three = async (i: any): Promise<void> => { this.q.push(`}${i}`) }
  four = i => i.x.y()
  get five() { return 5 }
  delete(id) { return this.one(id) }
  abstract six(): void;
  'quoted'() {}
  static { init() }
  *gen() { yield 1 }
  last() { const z: Zed = make(); z.run(); return new Foo().bar() }
}
class Hidden { m() {} }
"""
CS = r"""
using X;
namespace A.B;
[ApiController, Route(template: "api/items")]
public partial class ItemController<T>(IDb db) : ControllerBase where T : new()
{
    private readonly ItemService _items = new ItemService();
    public string P { get; set; } = "}";
    public int Q => 3;
    [HttpGet("{id}")][Authorize(Roles = "a,b")]
    public async Task<List<Dictionary<string, T>>> One<K>([FromRoute] int id) where K : class { var s = $"{{}} {x["}"]} {(a ? "}" : "{")}"; return _items.Find(id); }
    [HttpPut] public (int a, string b) Two() => (1, @"c:\\");
    public static ItemController operator +(ItemController a, ItemController b) { return a; }
    public ItemController(ItemService items) { _items = items; }
    ~ItemController() { }
    public int this[int i] { get { return i; } }
    class Nested { public void N() {} }
    char c = '}'; string raw = ""\" } " ""\";
    protected abstract void Three();
    public void Four() { Item it = _items.Get(); it.Save(); Two(); }
}
""".replace('""\\"', '"""')
JAVA = '''
package a; import b.C;
@RestController @RequestMapping(path = {"/items", "/x"}, produces = "p")
public class ItemController<T extends Comparable<T>> extends Base implements A, B {
  static { System.out.println("}"); }
  private final ItemService items; private char q = '}';
  enum E { A { void z() {} }, B; int f() { return 1; } }
  public ItemController(ItemService items) { this.items = items; }
  @GetMapping(value = "/{id}", name = "n") @Deprecated
  public <K> Map<String, List<K>> one(@PathVariable("id") String id, int[] b) throws X { return items.find(id, """
    } "text"
    """); }
  @RequestMapping public final int[] all() { class L { int q() { return 2; } } return new int[]{1}; }
  abstract void none();
  int plain() { return 1; }
  public static class In { public void x() { helper(); } }
  protected String last(Map<String, Other> m) { Foo<Bar> f = items.foo(); f.run(); return "a.b(" + m.get("x"); }
}
'''


def short(source: str, lang: str, **k) -> list[tuple]:
    return [(r[1], r[2], r[3], r[5], r[6], r[8]) for r in extract_source(source, lang, **k)]


def test_typescript():
    big = ("Big", "Injectable", "/")
    assert short(TS, "typescript") == [
        ("Inner", "Utility", "/", "go", None, None), (*big, "constructor", None, None), (*big, "one", "Get", ":id"), (*big, "two", None, None), (*big, "three", "Post", ""),
        (*big, "four", None, None), (*big, "five", None, None), (*big, "delete", None, None), (*big, "gen", None, None), (*big, "last", None, None),
    ]
    text = {r[5]: r[9] for r in extract_source(TS, "typescript")}
    assert text["one"].startswith("async one<K") and text["one"].endswith('g, "")) }') and text["three"].endswith("`}${i}`) }") and text["four"] == "four = i => i.x.y()"
    assert text["two"].endswith("return a / 2 / 3 }") and text["gen"] == "*gen() { yield 1 }"


def test_methods_after_a_regular_expression_stay():
    s = "export class A {\n  a(x) { return /[}]/.test(x) }\n  b() { return 1 }\n  c = (x) => x / 2\n  d() { return (1) / 2 / this.e }\n}"
    assert [r[5] for r in extract_source(s, "typescript")] == ["a", "b", "c", "d"]


def test_csharp():
    c = ("ItemController", "Controller", "api/items")
    assert short(CS, "c_sharp") == [(*c, "One", "Get", "{id}"), (*c, "Two", "Put", ""), (*c, "Three", None, ""), (*c, "Four", None, "")]
    assert [r[1] for r in short("namespace A { class X : C { public int F() { return 1; } } } class Y { int G() => 2; }", "c_sharp")] == ["Utility", "Utility"]
    assert {r[5]: r[9] for r in extract_source(CS, "c_sharp")}["Two"] == '[HttpPut] public (int a, string b) Two() => (1, @"c:\\\\");'


def test_java():
    c = ("ItemController", "RestController", "/items")
    assert short(JAVA, "java") == [(*c, "one", "Get", "/{id}"), (*c, "all", "All", ""), (*c, "last", None, None)]
    assert {r[0] for r in short(JAVA, "java", nested=True)} == {"ItemController", "In"}
    assert '} "text"' in extract_source(JAVA, "java")[0][9]


@pytest.mark.parametrize("lang", ["java", "c_sharp", "typescript", "python"])
@pytest.mark.parametrize("source", ["", "}", "{{{", "export class", "class A {", "class A { public void m(", "'", '"""', "`${", "@", "@A(", "[", "/* ", "export class A { x = ", "public class A { int f( ) { ", "a" * 50_000, "{" * 3000, "class A:\n  def"])
def test_faults_never_stop_a_file(source, lang):
    assert isinstance(extract_source(source, lang), list) and isinstance(facts_source(source, lang), list)


def test_types_and_calls():
    of = lambda s, lang, kind: {(r[1], r[3], r[4]) for r in facts_source(s, lang) if r[2] == kind}
    assert {(None, "items", "ItemService"), (None, "q", "Queue"), ("last", "z", "Zed")} <= of(TS, "typescript", "type")
    assert of(TS, "typescript", "call") >= {("one", "items", "find"), ("three", "q", "push"), ("delete", "this", "one"), ("last", "z", "run")}
    assert {r[3] for r in facts_source(TS, "typescript") if r[2] == "parent"} == {"Base", "I"}
    assert {("One", "_items", "Find"), ("Four", "it", "Save"), ("Four", "", "Two")} <= of(CS, "c_sharp", "call") and (None, "_items", "ItemService") in of(CS, "c_sharp", "type")
    assert ("last", "f", "run") in of(JAVA, "java", "call") and not any(x == ("last", "a", "b") for x in of(JAVA, "java", "call"))
    assert ("last", "m", "Map") in of(JAVA, "java", "type") and ("last", "f", "Foo") in of(JAVA, "java", "type")
    py = "s = Shop()\nclass A(B):\n    x: Store\n    def __init__(self, y: Yard):\n        self.y = y\n    def m(self):\n        z = Zed()\n        return self.y.go(z.run(), s.sell())\n"
    assert of(py, "python", "type") >= {(None, "s", "Shop"), (None, "x", "Store"), (None, "y", "Yard"), ("m", "z", "Zed")} and of(py, "python", "call") >= {("m", "y", "go"), ("m", "z", "run"), ("m", "s", "sell")}


FILES = [
    ("a/Shop.java", "public class Shop extends Base { private Store store; public int sell() { Clerk c = new Clerk(); c.call(); other_store.load(); return store.load() + lift(); } public int back() { return store.again(); } }"),
    ("a/Store.java", "public class Store { private Shop shop; public int load() { return 1; } public int again() { return shop.back(); } }"),
    ("a/Clerk.java", "public class Clerk { public void call() { log.info(); String s = \"store.load()\"; } }"),
    ("a/Base.java", "public class Base extends Root { public int lift() { return 2; } }"),
    ("a/OtherStore.java", "public class OtherStore { public int load() { return 3; } }"),
]


def test_call_graph_by_types(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    graph = mapping.call_graph(facts(files), extract(files))
    got = {(r.class_name, r.method_name, r.receiver, r.to_class, r.name) for r in graph.collect()}
    assert got == {("Shop", "sell", "c", "Clerk", "call"), ("Shop", "sell", "store", "Store", "load"), ("Shop", "sell", "", "Base", "lift"), ("Shop", "sell", "other_store", "OtherStore", "load"), ("Shop", "back", "store", "Store", "again"), ("Store", "again", "shop", "Shop", "back")}
    deps = {(r["class_name"], r["method"]): r["dependencies"] for r in mapping.dependencies(extract(files), facts=facts(files)).collect()}
    assert deps["Shop", "sell"] == ["c.call", "other_store.load", "store.load", "this.lift"] and deps["Clerk", "call"] == []
    reach = {(r.class_name, r.method_name, r.to_class, r.to_method, r.steps) for r in mapping.reaches(graph).collect()}
    assert {("Shop", "back", "Shop", "back", 2), ("Store", "again", "Store", "again", 2), ("Shop", "back", "Store", "again", 1)} <= reach and len(reach) == 8
    assert mapping.reaches(graph, rounds=1).count() == 6


def test_table_functions(spark):
    register(spark)
    spark.createDataFrame([("java", FILES[0][1]), ("java", None), ("go", "x"), ("python", "class (")], "lang string, content string").createOrReplaceTempView("src")
    assert [r.m for r in spark.sql("SELECT method_name AS m FROM src, LATERAL extract_methods(lang, content) ORDER BY ord").collect()] == ["sell", "back"]
    assert spark.sql("SELECT * FROM src, LATERAL extract_facts(lang, content) WHERE kind = 'call'").count() == 5
