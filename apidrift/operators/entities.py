"""Fold the rules of a path over syntax entities.

An entity (call, definition, parameter, decorated definition, import) is one row
holding its few tokens (``rows``) and the slim rules that can touch it (``ops``).
Each function below is one SQL expression: a left fold over ``ops`` whose state
holds the entity's current names, so a rule sees what the earlier rules made of
it, followed by the list of edits the final state amounts to.

An edit is a struct ``k, pos, end, o, m, c, txt, src``:

====  =======================================================================
k     meaning
====  =======================================================================
t, T  token ``pos`` becomes ``txt`` (``T`` wins over ``t``)
x     tokens ``pos..end`` disappear, at rule ``o``
r     tokens ``pos..end`` become ``txt``, at rule ``o``
q     trivia before ``pos`` becomes ``txt``
w     ``txt`` goes before the trivia of ``pos``
b     ``txt`` goes between the trivia and the token ``pos``
a     ``txt`` goes after the token ``pos``
g     decorator line ``txt`` follows the first line of the trivia of ``pos``
l, d  cut the first line of the trivia / the indent before ``pos``
S     tokens ``pos..end`` are laid out in the order ``src``
h, H  rule ``o`` made ``m`` changes at ``pos``; ``c``: the text differs after it
D     like ``h``, counted once per position and rule
z     like ``h``; the text differs if ``txt`` is not what ``src`` spans
====  =======================================================================
"""

from __future__ import annotations

from apidrift.operators.rulebook import OPERATIONS

EDIT_TYPE = "struct<k:string,pos:int,end:int,o:int,m:int,c:boolean,txt:string,src:array<int>>"
NONE = f"cast(array() as array<{EDIT_TYPE}>)"
LATEST = 2147483647
_INTS = "cast(array() as array<int>)"
_EVENTS = "cast(array() as array<struct<o:int,m:int,c:boolean>>)"
_NULL_INT = "cast(null as int)"

_REN = "r.op = 'rename'"
_ATTR = "r.op = 'rename_attr'"


def edit(k, pos, end="null", o="null", m="null", c="null", txt="null", src="null"):
    return (
        f"named_struct('k', '{k}', 'pos', cast({pos} as int), 'end', cast({end} as int), "
        f"'o', cast({o} as int), 'm', cast({m} as int), 'c', cast({c} as boolean), "
        f"'txt', cast({txt} as string), 'src', cast({src} as array<int>))"
    )


def _event(o, m, c):
    return f"named_struct('o', {o}, 'm', cast({m} as int), 'c', {c})"


def _renamed(toks):
    """Token texts after a rename rule ``r`` (attributes need a dot before them)."""
    return (
        f"case when {_REN} then transform({toks}, t -> if(t = r.a, r.b, t)) "
        f"when {_ATTR} then transform({toks}, (t, i) -> if(t = r.a and get({toks}, i - 1) = '.', r.b, t)) "
        f"else {toks} end"
    )


def _rename_count(toks):
    return (
        f"case when {_REN} then size(filter({toks}, t -> t = r.a)) "
        f"when {_ATTR} then size(filter({toks}, (t, i) -> t = r.a and get({toks}, i - 1) = '.')) "
        f"else 0 end"
    )


def _hits(events, pos):
    return f"transform({events}, v -> {edit('h', pos, o='v.o', m='v.m', c='v.c')})"


def _let(value, name, body):
    return f"transform(array({value}), {name} -> {body})[0]"


def name_edits() -> str:
    t = edit("t", "rows[0].pos", txt="final")
    h = edit("h", "rows[0].pos", o="v.o", m="1", c="v.c")
    return f"concat(array({t}), transform(hits, v -> {h}))"


_ARG = "named_struct('s', a.s, 'e', a.e, 'kw', {kw}, 'dead', {dead}, 'h', {h}, 're', {re})"


def drop_argument(name: str = "r.b") -> str:
    """The arguments of a call without that keyword."""
    return f"transform(s.args, a -> if(a.dead is null and a.kw = {name}, {_ARG.format(kw='a.kw', dead='r.o', h='a.h', re='a.re')}, a))"


def append_argument(name: str = "r.b", tokens: str = "r.toks") -> str:
    """The arguments to add to a call, with one more keyword."""
    return f"array_append(filter(s.add, d -> d.kw <> {name}), named_struct('kw', {name}, 'toks', {tokens}))"


def call_edits() -> str:
    """Calls: added, removed and renamed keyword arguments, properties, deprecation, registered operations."""
    args = f"""
      filter(transform(filter(rows, x -> x.tok <> ')'), (x, i) -> named_struct(
               's', x.pos + 1, 'e', rows[i + 1].pos - 1,
               'kw', case when x.next2 = '=' then x.next1 end,
               'dead', {_NULL_INT}, 'h', {_INTS}, 're', false)),
             a -> a.e >= a.s)
    """
    mine = "(s.live and r.a = s.cal)"
    have = "(exists(s.args, a -> a.dead is null and a.kw = {0}) or exists(s.add, d -> d.kw = {0}))"
    adds = f"({mine} and r.op = 'add_arg' and not coalesce({have.format('r.b')}, false))"
    drops = f"({mine} and r.op = 'remove_arg' and coalesce({have.format('r.b')}, false))"
    moves = f"({mine} and r.op = 'rename_arg' and coalesce({have.format('r.b')}, false))"
    prop = (
        f"({mine} and attr and r.op = 'property' and size(s.add) = 0 "
        "and not exists(s.args, a -> a.dead is null))"
    )
    marks = f"({mine} and ok and r.op = 'deprecate')"
    cal_hit = f"(r.a = s.cal and ({_REN} or (attr and {_ATTR})))"
    arg = _ARG
    own = {name: f"({mine} and r.op = '{name}' and {operation.acts})" for name, operation in OPERATIONS.items()}
    result = lambda part: " ".join(
        f"when {own[name]} then {value}" for name, operation in OPERATIONS.items() if (value := getattr(operation, part)))
    named = " or ".join(["false", *(own[name] for name, operation in OPERATIONS.items() if operation.callee)])
    noted = " ".join(f"when {acts} then array_append(s.ev, {_event('r.o', '1', 'true')})" for acts in own.values())
    add_hits = (
        f"aggregate(s.add, 0, (n, d) -> n + if({_REN} and d.kw = r.a, 1, 0) + {_rename_count('d.toks')})"
    )
    fold = f"""
      aggregate(ops,
        named_struct('cal', name, 'ch', {_INTS}, 'written', false, 'live', true, 'p', {_NULL_INT}, 'args', {args},
                     'add', cast(array() as array<struct<kw:string,toks:array<string>>>),
                     'ev', {_EVENTS}, 'dep', cast(array() as array<struct<o:int,t:string>>)),
        (s, r) -> named_struct(
          'cal', case {result('callee')} when {cal_hit} or {prop} then r.b else s.cal end,
          'ch', if({cal_hit}, array_append(s.ch, r.o), s.ch),
          'written', s.written or {named},
          'live', s.live and not {prop},
          'p', if({prop}, r.o, s.p),
          'args', case {result('args')}
             when {_REN} then transform(s.args, a -> if(a.dead is null and a.kw = r.a,
               {arg.format(kw='r.b', dead='a.dead', h='array_append(a.h, r.o)', re='a.re')}, a))
             when {drops} then transform(s.args, a -> if(a.dead is null and a.kw = r.b,
               {arg.format(kw='a.kw', dead='r.o', h='a.h', re='a.re')}, a))
             when {moves} then transform(s.args, a -> if(a.dead is null and a.kw = r.b,
               {arg.format(kw='r.c', dead='a.dead', h='a.h', re='true')}, a))
             else s.args end,
          'add', case {result('add')}
             when {_REN} or {_ATTR} then transform(s.add, d -> named_struct(
                'kw', if({_REN} and d.kw = r.a, r.b, d.kw), 'toks', {_renamed('d.toks')}))
             when {adds} then array_append(s.add, named_struct('kw', r.b, 'toks', r.toks))
             when {drops} then filter(s.add, d -> d.kw <> r.b)
             when {moves} then transform(s.add, d -> named_struct(
                'kw', if(d.kw = r.b, r.c, d.kw), 'toks', d.toks))
             else s.add end,
          'ev', case {noted}
             when ({_REN} or {_ATTR}) and size(s.add) > 0 and {add_hits} > 0
               then array_append(s.ev, {_event('r.o', add_hits, 'r.a <> r.b')})
             when {adds} or {drops} or {prop} then array_append(s.ev, {_event('r.o', '1', 'true')})
             when {moves} then array_append(s.ev, {_event('r.o', '1', 'r.b <> r.c')})
             else s.ev end,
          'dep', if({marks}, array_append(s.dep, named_struct('o', r.o, 't', concat(
              '# DEPRECATED: ', s.cal, '() is deprecated. Use ', r.b, ' instead.\\n', indent))), s.dep)))
    """
    open_pos, close_pos = "rows[0].pos", "element_at(rows, -1).pos"
    live = "filter(s.args, a -> a.dead is null)"
    added = (
        "array_join(transform(s.add, d -> concat(d.kw, '=', array_join(d.toks, ''))), ', ')"
    )
    last = "element_at(v, -1)"
    body = f"""
      concat(
        {_hits('s.ev', open_pos)},
        transform(filter(s.args, a -> a.dead is not null), a ->
          {edit('x', 'a.s', f'if(a.e + 1 = {close_pos}, a.e, a.e + 1)', o='a.dead')}),
        if(size(v) > 0 and (size(v) < size(s.args) or size(s.add) > 0) and {last}.e + 1 < {close_pos},
           array({edit('x', f'{last}.e + 1', f'{last}.e + 1', o=LATEST)}), {NONE}),
        if(size(s.add) > 0,
           array({edit('w', close_pos, txt=f"concat(if(size(v) > 0, ', ', ''), {added})")}), {NONE}),
        if(size(v) > 0 and v[0].s <> s.args[0].s,
           array({edit('q', 'v[0].s', txt='rows[0].next_pre')}), {NONE}),
        if(s.written, concat(
           array({edit('T', f'{open_pos} - 1', txt='s.cal')}),
           transform(s.ch, o -> {edit('H', f'{open_pos} - 1', o='o', m='1', c='true')})), {NONE}),
        if(s.p is not null, concat(
           array({edit('x', open_pos, close_pos, o='s.p')}, {edit('T', f'{open_pos} - 1', txt='s.cal')}),
           transform(s.ch, o -> {edit('H', f'{open_pos} - 1', o='o', m='1', c='true')})), {NONE}),
        flatten(transform(filter(v, a -> a.re), a -> concat(
           array({edit('T', 'a.s', txt='a.kw')}),
           transform(a.h, o -> {edit('H', 'a.s', o='o', m='1', c='true')})))),
        flatten(transform(s.dep, d -> array(
           {edit('b', 'line_pos', o='d.o', txt='d.t')},
           {edit('D', 'line_pos', o='d.o', m='1', c='true')}))))
    """
    return _let(fold, "s", _let(live, "v", body))


def parameter_edits(scoped: bool = False) -> str:
    """One parameter: its default value. ``scoped``: only where the rule names the definition that has the parameter."""
    sets = "(r.op = 'default' and r.b = s.cur" + (" and coalesce(r.a = s.fn, false))" if scoped else ")")
    eq, end = "rows[0].x1", "rows[0].x2"
    star = "if(rows[0].next1 in ('*', '**'), 2, 1)"
    new = "array_join(r.toks, '')"
    fold = f"""
      aggregate(ops,
        named_struct('cur', name, 'fn', fn, 'toks', cast(null as array<string>), 'o', {_NULL_INT},
                     'ev', cast(array() as array<struct<o:int,m:int,c:boolean,txt:string>>)),
        (s, r) -> named_struct(
          'cur', if({_REN} and r.a = s.cur, r.b, s.cur),
          'fn', if({_REN} and r.a = s.fn, r.b, s.fn),
          'toks', case when {sets} then r.toks when s.toks is not null then {_renamed('s.toks')} end,
          'o', if({sets}, coalesce(s.o, r.o), s.o),
          'ev', case
            when {sets} then array_append(s.ev, named_struct('o', r.o, 'm', 1,
               'c', case when s.toks is not null then array_join(s.toks, '') <> {new}
                         when {eq} is null then true end,
               'txt', {new}))
            when s.toks is not null and {_rename_count('s.toks')} > 0
              then array_append(s.ev, named_struct('o', r.o, 'm', {_rename_count('s.toks')},
                                                   'c', r.a <> r.b, 'txt', cast(null as string)))
            else s.ev end))
    """
    name_pos = f"rows[0].pos + {star}"
    body = f"""
      concat(
        transform(s.ev, v -> if(v.c is null,
          {edit('z', name_pos, o='v.o', m='v.m', txt='v.txt', src=f'array({eq} + 1, {end})')},
          {edit('h', name_pos, o='v.o', m='v.m', c='v.c')})),
        case when s.toks is null then {NONE}
             when {eq} is not null then array({edit('r', f'{eq} + 1', end, o='s.o', txt="array_join(s.toks, '')")})
             else array({edit('a', end, txt="concat(' = ', array_join(s.toks, ''))")}) end)
    """
    return _let(fold, "s", body)


def definition_edits() -> str:
    """Parameter order of a function definition."""
    params = """
      filter(transform(filter(rows, x -> x.tok <> ')'), (x, i) -> named_struct(
               's', x.pos + 1, 'e', rows[i + 1].pos - 1, 'name', x.next1,
               'pre', x.next_pre, 'sep', rows[i + 1])), p -> p.e >= p.s)
    """
    # plain parameters: after '/', before the first starred one
    plain = """
      filter(p, (x, i) -> i >= array_position(transform(p, y -> y.name), '/')
                 and not exists(slice(p, 1, i + 1), y -> y.name in ('*', '**')))
    """
    tidy = """
      forall(q, x -> case when x.sep.tok = ')' then true
                          when x.sep.next1 = ')' then false
                          else x.sep.pre = '' and x.sep.next_pre = ' ' end)
    """
    mine = "(r.op = 'reorder' and r.a = s.cal)"
    shuffled = """
      concat(flatten(transform(array_distinct(r.order), w -> filter(s.ps, y -> y.name = w))),
             filter(s.ps, y -> not array_contains(r.order, y.name)))
    """
    fold = f"""
      aggregate(ops,
        named_struct('cal', name, 'did', false, 'ev', {_EVENTS},
                     'ps', transform(q, y -> named_struct('s', y.s, 'e', y.e, 'name', y.name))),
        (s, r) -> named_struct(
          'cal', if({_REN} and r.a = s.cal, r.b, s.cal),
          'did', s.did or {mine},
          'ev', if({mine}, array_append(s.ev, {_event('r.o', '1',
              f"transform({shuffled}, y -> y.s) <> transform(s.ps, y -> y.s) or (not s.did and not {tidy})")}), s.ev),
          'ps', case when {mine} then {shuffled}
                     when {_REN} then transform(s.ps, y -> named_struct(
                        's', y.s, 'e', y.e, 'name', if(y.name = r.a, r.b, y.name)))
                     else s.ps end))
    """
    src = (
        "flatten(transform(s.ps, (y, j) -> concat("
        f"if(j > 0, array(q[j - 1].e + 1), {_INTS}), sequence(y.s, y.e))))"
    )
    body = f"""
      concat(
        {_hits('s.ev', 'rows[0].pos')},
        if(s.did and size(q) > 0, concat(
          array({edit('S', 'q[0].s', 'element_at(q, -1).e', src=src)}),
          transform(s.ps, (y, j) -> {edit('q', 'y.s', txt="if(j = 0, q[0].pre, ' ')")}),
          flatten(transform(q, y -> case
            when y.sep.tok = ')' then {NONE}
            when y.sep.next1 = ')' then array({edit('x', 'y.e + 1', 'y.e + 1', o=LATEST)})
            when y.s = element_at(q, -1).s
              then array({edit('q', 'y.e + 1', txt="''")}, {edit('q', 'y.e + 2', txt="' '")})
            else array({edit('q', 'y.e + 1', txt="''")}) end))), {NONE}))
    """
    return _let(params, "p", _let(plain, "q", _let(fold, "s", body)))


def decorator_edits() -> str:
    """Bare decorators of a function definition (the last row is the ``def`` line)."""
    head = "element_at(rows, -1)"
    mine = "r.a = s.cal"
    on = f"({mine} and r.op = 'add_decorator' and not exists(s.ds, d -> d.dead is null and d.name = r.b))"
    off = f"({mine} and r.op = 'remove_decorator' and exists(s.ds, d -> d.dead is null and d.name = r.b))"
    deco = "named_struct('at', d.at, 'name', {name}, 'dead', {dead})"
    own = "(d.dead is null and d.at is null and d.name = r.a)"
    fold = f"""
      aggregate(ops,
        named_struct('cal', name, 'ev', {_EVENTS},
          'ds', transform(filter(rows, x -> x.tok = '@'),
                          x -> named_struct('at', nullif(x.pos, -1), 'name', x.next1, 'dead', {_NULL_INT}))),
        (s, r) -> named_struct(
          'cal', if({_REN} and {mine}, r.b, s.cal),
          'ev', case
            when {on} or {off} then array_append(s.ev, {_event('r.o', '1', 'true')})
            when {_REN} and exists(s.ds, d -> {own}) then array_append(s.ev,
               {_event('r.o', f'size(filter(s.ds, d -> {own}))', 'r.a <> r.b')})
            else s.ev end,
          'ds', case
            when {_REN} then transform(s.ds, d -> if(d.dead is null and d.name = r.a,
               {deco.format(name='r.b', dead='d.dead')}, d))
            when {on} then array_append(s.ds,
               named_struct('at', {_NULL_INT}, 'name', r.b, 'dead', {_NULL_INT}))
            when {off} then transform(s.ds, d -> if(d.dead is null and d.name = r.b,
               {deco.format(name='d.name', dead='r.o')}, d))
            else s.ds end))
    """
    new = "filter(s.ds, d -> d.at is null and d.dead is null)"
    below = f"array_join(transform({new}, d -> concat(indent, '@', d.name, '\\n')), '')"
    above = f"array_join(transform({new}, d -> concat('@', d.name, '\\n', indent)), '')"
    body = f"""
      concat(
        {_hits('s.ev', f'{head}.pos')},
        flatten(transform(filter(s.ds, d -> d.at is not null and d.dead is not null), d -> array(
          {edit('x', 'd.at + 1', 'd.at + 1', o='d.dead')},
          {edit('d', 'd.at')}, {edit('l', 'd.at + 2')}))),
        case when size({new}) = 0 then {NONE}
             when {head}.x1 = 1 then array({edit('g', f'{head}.pos', txt=below)})
             else array({edit('b', f'{head}.pos', o='0', txt=above)}) end)
    """
    return _let(fold, "s", body)


def import_edits() -> str:
    """``from module import names``: module and alias names."""
    at = "cast(array_position(transform(rows, x -> x.tok), 'import') as int)"
    module = (
        f"filter(slice(rows, 2, greatest({at} - 2, 0)), "
        "x -> x.word or (x.tok = '.' and x.prev1 not in ('from', '.', '...')))"
    )
    names = (
        f"filter(slice(rows, {at} + 1, size(rows)), (x, i) -> x.word and x.tok <> 'as' and x.prev1 <> 'as')"
    )
    star = f"get(rows, {at}).tok = '*'"
    now = "array_join(s.segs, '.')"
    alias = "named_struct('pos', n.pos, 'name', {name}, 'h', {h}, 're', {re})"
    on_import = f"(r.op = 'import' and {now} = r.c and (star or exists(s.names, n -> n.name = r.a)))"
    on_move = f"(r.op = 'move' and not star and {now} = r.c and exists(s.names, n -> n.name = r.a))"
    seg_hits = (
        f"case when {_REN} then size(filter(s.segs, g -> g = r.a)) "
        f"when {_ATTR} then size(filter(s.segs, (g, i) -> i > 0 and g = r.a)) else 0 end"
    )
    fold = f"""
      aggregate(ops,
        named_struct('segs', transform(filter(mod, x -> x.word), x -> x.tok), 'o', {_NULL_INT},
          'names', transform(names, x -> named_struct('pos', x.pos, 'name', x.tok, 'h', {_INTS}, 're', false)),
          'ev', {_EVENTS}),
        (s, r) -> named_struct(
          'segs', case
            when {_REN} then transform(s.segs, g -> if(g = r.a, r.b, g))
            when {_ATTR} then transform(s.segs, (g, i) -> if(i > 0 and g = r.a, r.b, g))
            when {on_import} or {on_move} then split(r.d, '[.]')
            else s.segs end,
          'o', if({on_import} or {on_move}, coalesce(s.o, r.o), s.o),
          'names', case
            when {_REN} then transform(s.names, n -> if(n.name = r.a,
               {alias.format(name='r.b', h='array_append(n.h, r.o)', re='n.re')}, n))
            when {on_import} and not star then transform(s.names, n -> if(n.name = r.a,
               {alias.format(name='r.b', h='n.h', re='true')}, n))
            else s.names end,
          'ev', case
            when s.o is not null and {seg_hits} > 0
              then array_append(s.ev, {_event('r.o', seg_hits, 'r.a <> r.b')})
            when {on_import} then array_append(s.ev, {_event('r.o',
                "if(star, 0, size(filter(s.names, n -> n.name = r.a)))",
                'r.c <> r.d or (not star and r.a <> r.b)')})
            when {on_move} then array_append(s.ev, {_event('r.o', '1', 'r.c <> r.d')})
            else s.ev end))
    """
    body = f"""
      concat(
        {_hits('s.ev', 'rows[0].pos')},
        if(s.o is null, {NONE}, array(
          {edit('r', 'mod[0].pos', 'element_at(mod, -1).pos', o='s.o', txt=now)})),
        flatten(transform(filter(s.names, n -> n.re), n -> concat(
          array({edit('T', 'n.pos', txt='n.name')}),
          transform(n.h, o -> {edit('H', 'n.pos', o='o', m='1', c='true')})))))
    """
    return _let(module, "mod", _let(names, "names", _let(
        f"coalesce({star}, false)", "star", f"if(size(mod) = 0, {NONE}, {_let(fold, 's', body)})")))
