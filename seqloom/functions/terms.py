"""Typed programs as Spark expressions: nested tuples (node, arguments...) of types, terms, statements and declarations.

A term becomes one SQL expression. A method becomes one too: its variables are the fields of a struct, each statement makes the next struct, and a
loop is a fold over its steps, so a program runs on each row inside the engine. Within one term, assignments take effect from left to
right. A loop that does not end within `steps` is an error, never a silent stop. Integers have 64 bits; methods may call each other but not themselves.

Forms: ("TmVar", name), ("TmInteger", 1), ("TmAssign", name, term), ("TmPostInc", name), ("TmConversion", type, term), ("TmChoose", test, a, b), ("TmFieldAccess",
term, name), ("TmNew", class, ("TmList1", ...)), ("TmNewArray1", term, length), ("TmMethodInvocation", object, "Class.method", arguments), ("TmMethodInvocationNoObj", name, arguments);
("StDeclInit", type, name, term), ("StIfElse", test, a, b), ("StWhile", test, body), ("StFor", first, test, step, body), ("StForeach", type, name, term, body), ("StSwitch",
term, ("StSwitchCase", term or None, body)...), ("StConcat", ...); ("PgMethodDecl", type, name, ((type, name)...), body), ("PgConstructorDecl", class, parameters, body),
("PgFieldDeclInit", type, name, term), ("PgClassDecl", name, ("PgConcat", ...)).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import METHODS, filled

_TYPES = {"TyInt": "BIGINT", "TyFloat": "DOUBLE", "TyChar": "STRING", "TyBool": "BOOLEAN", "TyString": "STRING"}
_INFIX = {
    "TmAdd": "+", "TmSub": "-", "TmMul": "*", "TmMod": "%", "TmBitAnd": "&", "TmBitOr": "|", "TmBitXor": "^", "TmEq": "=", "TmNe": "<>", "TmLt": "<", "TmLe": "<=", "TmGt": ">", "TmGe": ">=", "TmDiv": "div",
}
_CALLS = {"TmConcat": "concat", "TmArrayAccess": "get", "TmArray1": "array", "TmShiftL": "shiftleft", "TmShiftR": "shiftright"}
_STEP = {"TmPostInc": "+", "TmPreInc": "+", "TmPostDec": "-", "TmPreDec": "-"}
HOLES = frozenset(("TyUnk", "TmUnk", "StUnk", "PgUnk"))


class Program:
    """Classes and methods to compile calls of. `steps`: the most steps of any loop."""

    def __init__(self, *declarations: tuple, steps: int = 64):
        self.steps, self.fresh, self.running = steps, count(), []
        self.methods: dict[str, tuple] = {}
        self.fields: dict[str, dict[str, tuple]] = {}  # class -> name -> (type, first value or None)
        self.constructors: dict[str, tuple] = {}
        for d in declarations:
            self._declare(d, "")

    def _declare(self, node: tuple, owner: str) -> None:
        kind, *args = node
        if kind in HOLES:
            raise ValueError(f"{kind} is a hole: there is nothing to run")
        if kind == "PgConcat":
            for d in args:
                self._declare(d, owner)
        elif kind == "PgClassDecl":
            self.fields[args[0]] = {}
            self._declare(args[1], args[0])
        elif kind in ("PgFieldDeclNoInit", "PgFieldDeclInit"):
            self.fields.setdefault(owner, {})[args[1]] = (args[0], args[2] if kind == "PgFieldDeclInit" else None)
        elif kind == "PgConstructorDecl":
            self.constructors[args[0]] = (args[1], args[2])
        elif kind == "PgMethodDecl":
            self.methods[f"{owner}.{args[1]}" if owner else args[1]] = (owner, *args)
        elif kind == "PgStatement":
            self.methods[f"{owner}.main" if owner else "main"] = (owner, ("TyVoid",), "main", (), args[0])
        else:
            raise ValueError(f"{kind} declares nothing")

    def type(self, node: tuple) -> str:
        """The SQL type. Arrows, void and lists of types are no types of values."""
        kind, *args = node
        if kind in _TYPES:
            return _TYPES[kind]
        if kind in ("TyArray", "TyGeneric1"):
            return f"ARRAY<{self.type(args[-1])}>"
        if kind == "TyGeneric0":  # a collection of anything: of strings
            return "MAP<STRING, STRING>" if "Map" in args[0] else "ARRAY<STRING>"
        if kind == "TyGeneric2":
            return f"MAP<{self.type(args[-2])}, {self.type(args[-1])}>"
        if kind == "TyClass":
            return f"STRUCT<{', '.join(f'{n}: {self.type(t)}' for n, (t, _) in self.fields[args[0]].items())}>"
        raise ValueError(f"{kind} is no type of a value")

    def types(self, node: tuple) -> list[str]:
        """The types in a list of types (TyConcat), or of an arrow's arguments and result."""
        return [x for a in node[1:] for x in self.types(a)] if node[0] in ("TyConcat", "TyArrow") else [] if node[0] == "TyVoid" else [self.type(node)]

    def _name(self) -> str:
        return f"v{next(self.fresh)}"

    # terms

    def term(self, node: tuple, env: dict[str, str]) -> str:
        """SQL of a term; `env` has the variables' SQL and is changed by assignments. Other names are columns."""
        kind, *args = node
        of = lambda *ts: [self.term(t, env) for t in ts]
        if kind == "TmVar":
            return env.get(args[0], args[0])
        if kind in ("TmInteger", "TmFloat"):
            return f"CAST({args[0]!r} AS {'BIGINT' if kind == 'TmInteger' else 'DOUBLE'})"
        if kind in ("TmChar", "TmString", "TmType"):
            return "'" + str(args[0]).replace("\\", "\\\\").replace("'", "\\'") + "'"
        if kind in ("TmNull", "TmTrue", "TmFalse"):
            return {"TmNull": "NULL", "TmTrue": "true", "TmFalse": "false"}[kind]
        if kind == "TmParenthesis":
            return f"({of(args[0])[0]})"
        if kind in _INFIX:
            a, b = of(*args)
            return f"({a} {_INFIX[kind]} {b})"
        if kind == "TmNeg":
            return f"(-{of(args[0])[0]})"
        if kind == "TmNot":
            return f"(NOT {of(args[0])[0]})"
        if kind == "TmBitNot":
            return f"(~{of(args[0])[0]})"
        if kind in ("TmAnd", "TmOr", "TmChoose"):
            test = of(args[0])[0]
            sides = [dict(env) for _ in args[1:]]
            out = [self.term(t, e) for t, e in zip(args[1:], sides)]
            yes, no = (sides[0], env if len(sides) == 1 else sides[1]) if kind != "TmOr" else (env, sides[0])
            for n in {n for s in sides for n in s if s[n] != env.get(n)}:
                env[n] = f"IF({test}, {yes[n]}, {no[n]})"
            return {"TmAnd": f"({test} AND {out[0]})", "TmOr": f"({test} OR {out[0]})", "TmChoose": f"IF({test}, {', '.join(out)})"}[kind]
        if kind == "TmAssign":
            env[args[0]] = of(args[1])[0]
            return env[args[0]]
        if kind in _STEP:
            old = env[args[0]]
            env[args[0]] = f"({old} {_STEP[kind]} 1)"
            return old if kind.startswith("TmPost") else env[args[0]]
        if kind == "TmConversion":
            return f"CAST({of(args[1])[0]} AS {self.type(args[0])})"
        if kind == "TmInstanceOf":
            return f"(typeof({of(args[0])[0]}) = lower('{self.type(args[1])}'))"
        if kind == "TmFieldAccess":
            return f"{of(args[0])[0]}.{args[1]}"
        if kind in ("TmArray0", "TmNewArray0"):
            return "CAST(array() AS ARRAY<BIGINT>)" if not args else f"CAST(array() AS ARRAY<{self.type(args[0])}>)"
        if kind == "TmNewArray1":
            return "array_repeat({}, CAST({} AS INT))".format(*of(*args))
        if kind in ("TmShiftL", "TmShiftR", "TmArrayAccess"):
            a, b = of(*args)
            return f"{_CALLS[kind]}({a}, CAST({b} AS INT))"
        if kind in ("TmConcat", "TmArray1"):
            return f"{_CALLS[kind]}({', '.join(of(*args))})"
        if kind == "TmNew":
            return self._new(args[0], of(*self._listed(args[1:])))
        if kind == "TmMethodInvocation":
            return self._invoke(args[1], of(args[0])[0], of(*self._listed(args[2:])))
        if kind == "TmMethodInvocationNoObj":
            given = of(*self._listed(args[1:]))
            return self.call(args[0], given) if args[0] in self.methods else f"{args[0]}({', '.join(given)})"
        raise ValueError(f"{kind} is a hole: there is nothing to run" if kind in HOLES else f"{kind} has no value")

    @staticmethod
    def _listed(args: list) -> list[tuple]:
        """Arguments, given one by one or as a list (TmList0, TmList1)."""
        return [x for a in args for x in (a[1:] if a[0] in ("TmList0", "TmList1") else (a,))]

    def _invoke(self, name: str, owner: str, given: list[str]) -> str:
        if name in self.methods:
            return self.call(name, given, owner)
        cls, method = name.split(".")
        return filled(METHODS[cls][method][1], (owner, *given))

    def _new(self, name: str, given: list[str]) -> str:
        if name not in self.fields:  # a collection: empty, or of the values given
            made = {"List": "new", "Set": "new", "Map": "new", "StringBuilder": "new"}[name]
            return f"array({', '.join(given)})" if given else METHODS["List" if name == "Set" else name][made][1]
        fields = self.fields[name]
        names, body = self.constructors.get(name, ((), ("StSkip",)))
        env: dict[str, str] = {}
        first = {n: f"CAST({self.term(v, env) if v else 'NULL'} AS {self.type(t)})" for n, (t, v) in fields.items()}
        state = self._run(("TyVoid",), names, given, body, first, name)
        v = self._name()
        return f"transform(array({state}), {v} -> named_struct({', '.join(f"'{n}', {v}.{n}" for n in fields)}))[0]"

    def call(self, name: str, given: list[str], this: str | None = None) -> str:
        """SQL of a method's result for arguments in SQL."""
        owner, kind, _, names, body = self.methods[name]
        if name in self.running:
            raise ValueError(f"{name} calls itself")
        self.running.append(name)
        fields = {n: f"{this}.{n}" for n in self.fields[owner]} if owner and this else {}
        out = f"({self._run(kind, names, given, body, fields, name)})._val"
        self.running.pop()
        return out

    # statements: SQL of the struct after them, from the name of the struct before

    def _run(self, kind: tuple, names: tuple, given: list[str], body: tuple, first: dict[str, str], what: str) -> str:
        if len(names) != len(given):
            raise ValueError(f"{what} takes {len(names)} arguments")
        types = {n: self.type(t) for t, n in (*names, *self._declared(body))}
        values = dict(zip((n for _, n in names), given))
        start = {n: f"CAST({values.get(n, 'NULL')} AS {t})" for n, t in types.items()} | {n: v for n, v in first.items() if n not in types}
        start |= {"_ret": "false", "_brk": "false", "_cont": "false", "_val": "CAST(NULL AS BIGINT)" if kind[0] == "TyVoid" else f"CAST(NULL AS {self.type(kind)})"}
        kinds = types | {"_val": "BIGINT" if kind[0] == "TyVoid" else self.type(kind)}
        self_types, self._types = getattr(self, "_types", {}), kinds
        v = self._name()
        out = f"transform(array({self._struct(start)}), {v} -> {self.statement(body, v, list(start))})[0]"
        self._types = self_types
        return out

    @staticmethod
    def _struct(env: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in env.items()) + ")"

    def _after(self, v: str, names: list[str], env: dict[str, str]) -> str:
        """The struct `v` with what has changed in `env`."""
        cast = lambda n, e: f"CAST({e} AS {self._types[n]})" if n in self._types else e
        return self._struct({n: cast(n, env[n]) if env[n] != f"{v}.{n}" else env[n] for n in names})

    def _declared(self, node: tuple) -> list[tuple]:
        """(type, name) of all declarations in a statement."""
        if not isinstance(node, tuple):
            return []
        if node and node[0] in ("StDeclInit", "StDeclNoInit"):
            return [(node[1], node[2])]
        own = [(node[1], node[2])] if node and node[0] == "StForeach" else []
        return own + [d for a in node if isinstance(a, tuple) for d in self._declared(a)]

    def statement(self, node: tuple, v: str, names: list[str]) -> str:
        kind, *args = node
        env = {n: f"{v}.{n}" for n in names}
        done = f"({v}._ret OR {v}._brk OR {v}._cont)"
        if kind in HOLES:
            raise ValueError(f"{kind} is a hole: there is nothing to run")
        if kind in ("StSkip", "StDeclNoInit"):
            return v
        if kind == "StConcat":
            out, w = [], v
            for s in args:
                out.append((w, self.statement(s, w, names)))
                w = self._name()
            sql = w
            for i in reversed(range(len(out))):
                sql = out[i][1] if i == len(out) - 1 else self._let(out[i][1], out[i + 1][0], sql)
            return sql if args else v
        if kind == "StDeclInit":
            env[args[1]] = self.term(args[2], env)
        elif kind == "StExpression":
            self.term(args[0], env)
        elif kind == "StReturn":
            if args:
                env["_val"] = self.term(args[0], env)
            env["_ret"] = "true"
        elif kind in ("StBreak", "StContinue"):
            env["_brk" if kind == "StBreak" else "_cont"] = "true"
        elif kind in ("StIf", "StIfElse"):
            w = self._name()
            tested = self._tested(args[0], v, names)
            yes, no = (self._then(w, names, s) for s in (args[1], args[2] if kind == "StIfElse" else ("StSkip",)))
            return f"IF({done}, {v}, {self._let(tested, w, f'IF({w}._t, {yes}, {no})')})"
        elif kind == "StWhile":
            return f"IF({done}, {v}, {self._loop(args[0], None, args[1], v, names)})"
        elif kind == "StDoWhile":  # (body, test)
            w = self._name()
            once = self._let(self.statement(args[0], v, names), w, self._set(w, names, _cont="false"))
            x = self._name()
            return f"IF({done}, {v}, {self._let(once, x, self._loop(args[1], None, args[0], x, names))})"
        elif kind == "StFor":
            w = self._name()
            return f"IF({done}, {v}, {self._let(self.statement(args[0], v, names), w, self._loop(args[1], args[2], args[3], w, names))})"
        elif kind == "StForeach":
            a, x, w = self._name(), self._name(), self._name()
            inside = self._let(self._after(a, names, {n: f"{a}.{n}" for n in names} | {args[1]: x}), w, self.statement(args[3], w, names))
            y = self._name()
            step = f"IF({a}._ret OR {a}._brk, {a}, {self._let(inside, y, self._set(y, names, _cont='false'))})"
            z = self._name()
            return f"IF({done}, {v}, {self._let(f'aggregate({self.term(args[2], env)}, {v}, ({a}, {x}) -> {step})', z, self._set(z, names, _brk='false'))})"
        elif kind == "StSwitch":
            return f"IF({done}, {v}, {self._switch(args, v, names)})"
        else:
            raise ValueError(f"{kind} is no statement")
        return f"IF({done}, {v}, {self._after(v, names, env)})"

    def _cast(self, name: str, e: str, v: str) -> str:
        return f"CAST({e} AS {self._types[name]})" if name in self._types and e != f"{v}.{name}" else e

    @staticmethod
    def _let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    def _tested(self, test: tuple, v: str, names: list[str]) -> str:
        """The struct after a test, with its outcome as _t."""
        env = {n: f"{v}.{n}" for n in names}
        holds = self.term(test, env)
        return self._struct({**{n: self._cast(n, e, v) for n, e in env.items()}, "_t": holds})

    def _then(self, w: str, names: list[str], node: tuple) -> str:
        """A statement on the variables of a struct that has more."""
        u = self._name()
        return self._let(self._set(w, names), u, self.statement(node, u, names))

    def _set(self, v: str, names: list[str], **new: str) -> str:
        return self._struct({n: new.get(n, f"{v}.{n}") for n in names})

    def _loop(self, test: tuple, step: tuple | None, body: tuple, v: str, names: list[str]) -> str:
        """Steps until the test fails (or a break, or a return); one more look at the test than steps, then an error."""
        a, w, x, y, z = (self._name() for _ in range(5))
        after = {n: f"{x}.{n}" for n in names}
        if step:
            self.term(step, after)
        moved = self._let(self._set(y, names, _cont="false"), x, f"IF({x}._ret OR {x}._brk, {x}, {self._after(x, names, after)})")
        once = self._let(self._tested(test, a, names), w, f"IF({w}._t, {self._let(self._then(w, names, body), y, moved)}, {self._set(w, names, _brk='true')})")
        fold = f"aggregate(sequence(0, {self.steps}), {v}, ({a}, {self._name()}) -> IF({a}._ret OR {a}._brk, {a}, {once}))"
        return self._let(fold, z, f"IF({z}._ret OR {z}._brk, {self._set(z, names, _brk='false')}, raise_error('a loop has more than {self.steps} steps'))")

    def _switch(self, args: list, v: str, names: list[str]) -> str:
        """Cases from the first that equals the value on, until a break; the last may be for all others."""
        env = {n: f"{v}.{n}" for n in names}
        value, s = self.term(args[0], env), self._name()
        tests = [f"({s} = {self.term(c[1], env)})" if c[1] else "true" for c in args[1:]]
        none = " OR ".join(t for t in tests if t != "true") or "false"
        out, now = [], v
        for i, case in enumerate(args[1:]):
            hit = " OR ".join(t for t in tests[: i + 1] if t != "true") or "false"
            if case[1] is None:
                hit = f"({hit}) OR NOT ({none})"
            out.append((now, f"IF({hit}, {self.statement(case[2], now, names)}, {now})"))
            now = self._name()
        sql = self._set(now, names, _brk="false")
        for after, (_, state) in reversed(list(zip([o[0] for o in out[1:]] + [now], out))):
            sql = self._let(state, after, sql)
        return self._let(value, s, sql)


def column(term: tuple, program: Program | None = None) -> Column:
    """The column of a term such as ("TmAdd", ("TmVar", "x"), ("TmInteger", 1)), whose variables are columns."""
    return F.expr((program or Program()).term(term, {}))


def result(program: Program, method: str, *arguments: str) -> Column:
    """The column of a method's result for arguments (columns by name, or SQL)."""
    return F.expr(program.call(method, list(arguments)))
