from modweave.functions.scanner import mask_sfc, scan, strip_comments, strip_templates


def got(code, **kw):
    return [(x.request, x.kind) for x in scan(code.encode(), **kw)]


def test_static_imports():
    assert got("import a from 'a'\nimport {b as c, type D} from \"./b\";import 'side'") == [("a", "mixed"), ("./b", "mixed"), ("side", "mixed")]


def test_type_imports():
    code = "import type {A} from 'a'; import {type B, type C as D} from 'b'; import {type E, f} from 'c'; export type {G} from 'g'"
    assert got(code) == [("a", "only_type"), ("b", "only_type"), ("c", "mixed"), ("g", "only_type")]
    assert got(code, ignore_types=True) == [("c", "mixed"), ("g", "only_type")]


def test_dynamic_imports_in_blocks():
    code = "function f() { const x = require('r'); return import(/* webpackChunkName: 'n' */ './lazy(1)/x') }\nobj.require('no'); obj . import('no'); importx('no')"
    assert [(x.request, x.is_dynamic) for x in scan(code.encode())] == [("r", True), ("./lazy(1)/x", True)]


def test_not_literal_argument():
    assert got("import(path); require(a + 'b'); import(`./x`)") == []


def test_strings_comments_and_regular_expressions_are_passed_over():
    code = "const s = \"import a from 'no'\"; // import b from 'no'\n/* require('no') */ const r = /['\"]/g; x = a / b; const t = `require('no')`;\nimport c from 'yes'"
    assert got(code) == [("yes", "mixed")]


def test_exports():
    code = "export * from './a'; export * as ns from './b'\nexport { x as y, type T } from './c';\nexport const q = 1\nexport default function z() {}\nexport { q as w }\n"
    found = scan(code.encode(), detailed=True)
    assert [(x.request, x.is_local_export, [(k.name, k.alias, k.is_type) for k in x.keywords]) for x in found] == [
        ("./a", False, [("*", "", False)]), ("./b", False, [("*", "ns", False)]), ("./c", False, [("x", "y", False), ("T", "", True)]),
        ("", True, [("q", "", False)]), ("", True, [("default", "", False)]), ("", True, [("q", "w", False)]),
    ]
    local = found[-1].export
    assert code[local[0] : local[5]] == "export { q as w }"
    assert code[found[2].start : found[2].end] == "./c"


def test_local_declarations():
    code = "export async function* g() {}\nexport class K {}\nexport enum E {}\nexport interface I {}\nexport type T = { a: string;\n b: number }\nexport let v = 2\n"
    assert [(k.name, k.is_type) for x in scan(code.encode(), detailed=True) for k in x.keywords] == [("g", False), ("K", False), ("E", False), ("I", True), ("T", True), ("v", False)]


def test_ambient_and_namespace_bodies():
    code = "declare module 'm' { import x from 'no'; export const a: number }\nexport namespace N { export const b = 1 }\nimport y from 'yes'"
    assert [x.request for x in scan(code.encode(), detailed=True)] == ["", "yes"]


def test_keywords_of_imports():
    (x,) = scan(b"import D, { a, type B as C, 'str' as s } from 'm'", detailed=True)
    assert [(k.name, k.alias, k.is_type, k.position) for k in x.keywords] == [("default", "D", False, 0), ("a", "", False, 1), ("B", "C", True, 2), ("str", "s", False, 3)]
    (x,) = scan(b"import * as ns from 'm'", detailed=True)
    assert [(k.name, k.alias) for k in x.keywords] == [("*", "ns")]


def test_misspelt_from():
    assert got("import X form 'mod'\nconst y = 1") == [("mod", "mixed")]


def test_byte_offsets():
    code = "const é = 'ü'; import a from './ß'".encode()
    (x,) = scan(code)
    assert code[x.start : x.end].decode() == "./ß"


def test_components():
    vue = "<template><a>import x from 'no'</a></template>\n<script setup lang=\"ts\">\nimport a from './a'\n</script>\n"
    (x,) = scan(vue.encode(), "c.vue")
    assert vue[x.start : x.end] == "./a"
    svelte = "<script context=\"module\">export let kept = 1</script><script>export let prop; import b from 'b'</script>"
    found = scan(svelte.encode(), "c.svelte", detailed=True)
    assert [(x.request, x.is_local_export) for x in found] == [("", True), ("b", False)]
    assert len(mask_sfc(vue)) == len(vue)


def test_strip():
    assert strip_comments("a // b\n'//c' /* d */ e") == "a \n'//c'  e"
    assert strip_templates("x = css`a ${b}`; y = `kept`") == "x = css; y = `kept`"
    assert strip_templates("return f`kept` + (a)`kept` + b[0]`kept` + s.div`gone\\``") == "return f`kept` + (a)`kept` + b[0]`kept` + s.div"


def test_words_in_markup_and_names():
    code = "import { Q } from './q'\nfunction V() { return <P>please import the export, require nothing</P> }\nconst importer = 1, exports_ = [ 'x/y.ts' ]; export_thing = wrap(require('z'))\n"
    assert got(code) == [("./q", "mixed"), ("z", "mixed")]


def test_comments_inside_statements():
    assert got("export\n /* q from 'no' */\n * from \"p\"\n") == [("p", "mixed")]
    assert got("import { q, // r from 'no'\n s /* t from 'no' */ } from 'w'") == [("w", "mixed")]
    assert got("export class K { // q from 'no'\n}\n") == []


def test_local_exports_are_no_imports():
    for code in ("export default V", "export const V = 'v'", "export type T = {}", "export interface T {}", "export async function f() {}", "export { V, W }"):
        assert got(code) == [], code
    assert got("export { V }\nimport w from 'w'") == [("w", "mixed")]
    assert [x.request for x in scan(b"export type T = A & {\n  p: boolean;\n};\nconst C = lazy(() => import('~/c'));", detailed=True)] == ["", "~/c"]


def test_brackets_and_divisions():
    assert got("require(((\"p\")))") == [("p", "mixed")]
    assert got("import a from 'a'; const q = m[1] / g() / 2; const r = (w) => { return w / 3 / 4 }\nimport b from 'b'") == [("a", "mixed"), ("b", "mixed")]
    assert got("import a from 'a'; function g(s) { return /[\"'/]/.test(s) && s.split(/\\/'/) }\nimport b from 'b'") == [("a", "mixed"), ("b", "mixed")]


def test_members_are_passed_over():
    assert got("api.from('./no'); api.type('x')\nexport { B } from './yes'\n{ api . require('no'); api.import('no') }") == [("./yes", "mixed")]


def test_types_in_local_lists():
    (x,) = scan(b"export { A, type B }", detailed=True)
    assert [(k.name, k.is_type) for k in x.keywords] == [("A", False), ("B", True)]
    assert scan(b"export { A, type B }") == []


def test_places_of_lists():
    code = b"export { a, b as c, } from './m' ;\nexport { d };"
    one, two = scan(code, detailed=True)
    assert code[one.export[3] : one.export[4]] == b"{ a, b as c, }" and code[one.export[0] : one.export[5]] == b"export { a, b as c, } from './m' ;"
    assert [code[k.comma_after : k.comma_after + 1] for k in one.keywords] == [b",", b","] and two.keywords[0].comma_after == 0


def test_deep_nesting():
    code = "if (a) { while (b) { try { require('x') } catch { import('y') } } }\nexport const z = `${f({ a: `}` })}`\nimport q from 'q'"
    assert [r for r, _ in got(code)][:2] == ["x", "y"]
    assert got("") == [] and got("import") == [] and got("export {") == [] and got("import {a") == [] and got("require(") == [] and got("import(") == []
