import pytest

from lodestone.operators import extract as x

SOURCE = """// import nothing from 'nowhere'
import Def, { a, b as c, type T } from './one'
import * as ns from "two"
import './side'
import type { U } from './types'
const re = /import { z } from 'q'/g, text = `export const inner = ${a + "}"}`
export function run(p: string, q = { k: 1 }): number {
  return p.length / 2
}
export const first = 1, second = (() => 2)()
export const { gone } = ns
export default class Main extends Base {
  method() { import('lazy') }
}
export { x as y, z } from './three'
export * from './four'
export * as five from './five'
export interface Shape { a: string }
export type Name<T> = T | string
export enum Color { Red, Green }
function helper() { return c(run(first)) }
type Local = { deep: { type: string } }
"""


def test_imports():
    a = x.analyze("m.ts", SOURCE)
    assert a.imports == [("./one", "Def", "Default"), ("./one", "a", "Named"), ("./one", "b", "Named"), ("./one", "T", "Named"), ("two", "*", "Namespace"), ("./types", "U", "Named")]


def test_exports():
    a = x.analyze("m.ts", SOURCE)
    assert a.exports == [("run", "Function"), ("first", "Variable"), ("second", "Variable"), ("default", "Default"), ("Shape", "Interface"), ("Name", "TypeAlias"), ("Color", "Enum")]
    assert a.reexports == [("./three", "x", "y"), ("./three", "z", "z"), ("./four", "*", "*"), ("./five", "*", "five")]


def test_signatures():
    a = x.analyze("m.ts", SOURCE)
    assert a.signatures == [
        "const re",
        "const text",
        "export function run(p: string, q =",
        "export const first",
        "export const second",
        "export default class Main",
        'export * from "./four"',
        'export * as five from "./five"',
        "export interface Shape",
        "export type Name",
        "export enum Color",
        "function helper()",
        "type Local = { deep: { type: string } }",
    ]


def test_symbols():
    s = {n: (e, r) for n, e, r in x.analyze("m.ts", SOURCE).symbols}
    assert s["run"] == (True, 1) and s["helper"][0] is False and s["ns"][0] is False
    assert "gone" not in s and "inner" not in s


@pytest.mark.parametrize(
    "source, signatures",
    [
        ("export default function named(a) {}", ["export default function named(a)"]),
        ("export default function () {}", ["export function default(...)"]),
        ("export default 42", ["export default ..."]),
        ("export async function go() {}\nexport function* gen() {}", ["export async function go()", "export function* gen()"]),
        ("class A {}\nclass B {}", ["class A", "class B"]),
        ("let a = 1\nlet b = 2\nvar {c} = a", ["let a", "let b"]),
        ("export {a, b}", []),
        ("", []),
        ("}{ ) `unclosed ${", []),
    ],
)
def test_forms(source, signatures):
    assert x.analyze("m.js", source).signatures == signatures


def test_truncation_keeps_characters():
    assert x.truncate("aé" * 60, 100) == ("aé" * 60).encode()[:100].decode(errors="ignore")
    assert x.truncate("é", 1) == ""


def test_unknown_ending():
    with pytest.raises(ValueError):
        x.analyze("m.py", "")


def test_parse_in_spark(spark):
    rows = [("a.ts", "import {b} from './b'\nexport const a = b"), ("c.py", "x"), ("n.ts", None)]
    p = x.parse_sources(spark.createDataFrame(rows, "path string, content string"))
    got = {r["path"]: r for r in p.collect()}
    assert not got["a.ts"]["failed"] and got["c.py"]["failed"] and got["n.ts"]["failed"]
    assert [(r["name"], r["kind"], r["is_exported"]) for r in x.symbol_rows(p).orderBy("name").collect()] == [("a", "Variable", True), ("b", "Variable", False)]
    assert x.import_rows(p).collect()[0]["source"] == "./b"
    assert x.reexport_rows(p).count() == 0


LINES = ["import { n12 } from './m3' // import x from 'y'", "export { a as n4 } from \"./m5\"", "import * as n6 from './m7';", "export function f_01(a: string, b = `x${1}`) { return /[{]/ }", "function f_011() {}", "class S_3 { run() { } }", "const S_4 = { k: 'export const no = 1' }", "export const S_4 = 1, q2 = n12", "type T1 = string | 22", "", "// c 12", "const y = \"{0}\" + \"{}\""]


def test_lines_by_shape_are_as_the_whole_text(monkeypatch):
    import random

    rng, scanned, whole = random.Random(4), [], x.tokens
    texts = ["\n".join("".join(rng.choice("0123456789") if c.isdigit() else c for c in rng.choice(LINES)) for _ in range(rng.randrange(12))) for _ in range(400)]
    got = [x.analyze("m.ts", t) for t in texts]
    monkeypatch.setattr(x, "tokens", lambda t: scanned.append(t) or whole(t))
    assert [x.analyze("m.ts", t) for t in texts] == got
    # shapes known, a text is not scanned again, unless a line looks like the declaration of the function after it
    assert len(scanned) < len(texts) / 4
    monkeypatch.setattr(x, "_by_lines", lambda t: None)
    assert [x.analyze("m.ts", t) for t in texts] == got


@pytest.mark.parametrize("text", ["const a = `x\n${1}`", "let b = {\n}", "x = 5\n/ 2 /\nconst a = 1", "const z = 'a\\\nconst q = 1'", "/* a\nconst b = 1\n*/", "function  S_9() {}\nfunction S_9() {}", "function f_1() {}\nfunction f_(a) {}", "const w = x1.\nreturn", "const a =\nconst", "const é = 1\nconst b = é", "const u = 'a\u001fb'", "class A1 extends\nclass B1 {}"])
def test_lines_that_depend_on_others(monkeypatch, text):
    got = x.analyze("m.ts", text)
    monkeypatch.setattr(x, "_by_lines", lambda t: None)
    assert x.analyze("m.ts", text) == got


def test_only_the_columns_asked_for(spark):
    rows = [("a.ts", "import {b} from './b'\nexport const a = b"), ("c.py", "x"), ("n.ts", None), ("e.ts", "")]
    p = x.parse_sources(spark.createDataFrame(rows, "path string, content string"), ("imports", "signatures"))
    assert p.columns == ["path", "imports", "signatures"]
    got = {r["path"]: r for r in p.collect()}
    assert [tuple(i) for i in got["a.ts"]["imports"]] == [("./b", "b", "Named")] and got["a.ts"]["signatures"] == ["export const a"]
    assert got["c.py"]["imports"] is None and got["n.ts"]["signatures"] is None and got["e.ts"]["imports"] == []
