"""Units of brace languages: what opens what, strings and comments, broken code, offsets."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import brace_units, code_units

CPP = '''#include <vector>
#define MAXN 10
#define SQR(x) \\
  ((x) * (x))

namespace engine {
namespace detail {

// A point
// in the plane.
struct Point {
  int x, y;
  Point() : x(0), y(0) {
    x = SQR(2);
  }
  bool operator==(const Point &o) const {
    return x == o.x;
  }
};
}

/** Any shape. */
class Shape : public Point {
public:
  virtual ~Shape() {
    // } not an end {
    const char *s = "}{";
    auto r = R"x(}}})x";
  }
  int area() const override;
};

template <class T, typename U = int>
T clampv(T v,
         T lo) {
  if (v < lo) {
    return lo;
  } else {
    return v;
  }
}

int engine::total(const std::vector<int> &v) {
  int s = 0;
  for (int i = 0; i < 3; ++i) {
    s += v[i];
  }
  for (auto x : v)
    if (x)
      s += x;
  do {
    s--;
  } while (s > 0);
  while (s) {
    s /= 2;
  }
  int a[] = {
    1, 2};
  auto f = [&](int q) {
    return q;
  };
  return s;
}
}
'''
CUDA = '''__global__ void __launch_bounds__(256) add(const float *a,
                    float *b) {
  int i = threadIdx.x;
  b[i] += a[i];
}
'''
TS = '''export interface Item {
  id: number;
}

@Component({ selector: "x" })
export class Store extends Base<Item> {
  private items: Item[] = [];
  constructor(private a: number) {
    super();
  }
  async load(id: string): Promise<Item> {
    const s = `text ${id} }`;
    for (const k of this.items) {
      use(k);
    }
    return fetch(id);
  }
}

export const twice = (x: number): number => {
  return x * 2;
};

function run() {
  [1].forEach((v) => {
    use(v);
  });
}
'''


def found(source, path="a.cpp", **kw):
    return [(u["unit_type"], u["name"], u["lineno"], u["lineno"] + u["line_count"] - 1) for u in brace_units.brace_units(source, path, **kw)]


def test_cpp():
    got = found(CPP)
    assert [(k, n) for k, n, *_ in got] == [
        ("macro", "MAXN"), ("macro", "SQR"), ("namespace", "engine"), ("namespace", "detail"), ("class", "Point"), ("function", "Point"), ("function", "operator=="), ("class", "Shape"),
        ("function", "~Shape"), ("function", "clampv"), ("function", "engine::total"), ("loop", "for_loop_L45"), ("loop", "for_loop_L48"), ("loop", "do_while_loop_L51"), ("loop", "while_loop_L54"),
    ]
    assert {n: (a, b) for _, n, a, b in got if n in ("SQR", "detail", "clampv", "for_loop_L48", "do_while_loop_L51", "engine")} == {
        "SQR": (3, 4), "detail": (7, 20), "clampv": (33, 41), "for_loop_L48": (48, 50), "do_while_loop_L51": (51, 53), "engine": (6, 64)
    }
    assert {u["name"]: u["docstring"] for u in brace_units.brace_units(CPP, "a.cpp") if u["docstring"]} == {"Point": "A point\nin the plane.", "Shape": "Any shape."}
    assert not [k for k, *_ in found(CPP, extended=False) if k in ("namespace", "macro")]


def test_cuda_and_typescript():
    assert found(CUDA, "k.cu") == [("function", "add", 1, 5)]
    got = found(TS, "m.ts")
    assert [(k, n) for k, n, *_ in got] == [("class", "Item"), ("class", "Store"), ("function", "constructor"), ("function", "load"), ("loop", "for_loop_L13"), ("function", "twice"), ("function", "run"), ("function", "function_L25")]
    assert got[1][2:] == (5, 18)


@pytest.mark.parametrize(
    "source, want",
    [
        ("void f() {\n  g(;\n}\nvoid h() {\n}\n", [("function", "f", 1, 3), ("function", "h", 4, 5)]),
        ("}\n)\nint f(int a)\n{\n}\n", [("function", "f", 3, 5)]),
        ("void f() {\n  if (x) {\n  g();\n", [("function", "f", 1, 3)]),
        ("#if A\nvoid f(int a) {\n#else\nvoid f() {\n#endif\n  g();\n}\nint h() {\n}", [("function", "f", 4, 7), ("function", "h", 8, 9)]),
        ("typedef struct {\n int a;\n} T;\nstruct T x = {\n 1 };\nenum class E : int {\n A };\n", [("class", "class_L1", 1, 3), ("class", "E", 6, 7)]),
        ("switch (x) {\ncase 1: {\n}\n}\n", []),
        ('extern "C" {\nint f(void) {\n}\n}\n', [("function", "f", 2, 3)]),
        ("", []),
        (None, []),
        ('"never closed\n/* never', []),
    ],
)
def test_odd_and_broken_code(source, want):
    assert found(source) == want


def test_generated_nests():
    """Units of generated code come back with their lines, whatever stands in its strings and comments."""
    rng = random.Random(2)

    def block(depth, lines, want):
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["function", "class", "namespace", "loop", "text"])
            n = len(lines) + 1
            lines.extend([rng.choice(["// } {", '/* } */ x = "{";', "y = '{';", "int z;"])] if kind == "text" else [])
            if kind == "text":
                continue
            opens = {"function": f"int f{n}(int a) const {{", "class": f"class C{n} : public B<int> {{", "namespace": f"namespace n{n} {{", "loop": "for (;;) {"}
            lines.append(opens[kind])
            lines.append("int q; // }}")
            if depth < 4:
                block(depth + 1, lines, want)
            lines.append("};" if kind == "class" else "}")
            want.append((kind, {"function": f"f{n}", "class": f"C{n}", "namespace": f"n{n}", "loop": f"for_loop_L{n}"}[kind], n, len(lines)))

    for _ in range(60):
        lines, want = [], []
        block(0, lines, want)
        assert found("\n".join(lines)) == sorted(want, key=lambda w: w[2])


def test_offsets_and_coverage(spark):
    files = spark.createDataFrame([("a.cpp", "// ünü\r\n" + CPP.replace("\n", "\r\n")), ("k.cu", CUDA), ("m.ts", TS), ("x.py", "def f():\n  pass\n"), ("n.h", None)], "path string, text string")
    files = files.withColumn("text", code_units.normalized(F.encode("text", "utf-8")))
    units = brace_units.extract_brace_units(files)
    texts = {r.path: (r.text or "").encode() for r in files.collect()}
    rows = units.collect()
    assert {r.path for r in rows} == {"a.cpp", "k.cu", "m.ts"}
    assert all(texts[r.path][r.byte_offset : r.end_offset].decode() == r.code for r in rows)
    covered = code_units.unit_coverage(units, files.where("path <> 'n.h'").select("path", F.octet_length("text").cast("long").alias("size")))
    assert covered.first()[-1] >= 0.5
