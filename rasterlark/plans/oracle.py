"""The registered queries in DuckDB SQL, over the same given tables.

Written from the definitions, not from the Spark plans: cells by group-by on
the pair, colours by join, painter's order by arg_max, lines unclipped.
DuckDB rounds in CAST, hence trunc() wherever a number is narrowed to INTEGER.
"""

from __future__ import annotations

from rasterlark.operators.glyphs import ADVANCE, FALLBACK, glyph_segments
from rasterlark.plans.oracle_boxes import SIDE_PLACES, SIDES, box_oracles, ground_sql
from rasterlark.spec import (
    BACKGROUND_POINTS,
    BACKGROUND_RANGES,
    CLASS_COLORS,
    OBJECT_INTENSITY_RANGE,
    OBJECT_Z_RANGE,
    POINTS_BY_CLASS,
    POINTS_OTHER_CLASS,
    SCENE_OBJECTS,
)

# -- derived tables -----------------------------------------------------------

POINTS_V = """points_v AS (
  SELECT l_linenumber AS frame_id,
         CAST(((l_orderkey*7919 + l_linenumber*104729) % 50000)/1000::DOUBLE
              + CASE WHEN l_linenumber = 7 THEN 100::DOUBLE ELSE 0::DOUBLE END AS FLOAT) AS x,
         CAST(CASE WHEN l_partkey % 101 = 0 THEN 19.9999981::DOUBLE
              ELSE ((l_partkey*6151 + l_suppkey*389) % 50000)/1000::DOUBLE - 25::DOUBLE END AS FLOAT) AS y,
         CAST(CASE WHEN l_orderkey % 97 = 1 THEN NULL
                   WHEN l_orderkey % 89 = 1 THEN 'NaN'::DOUBLE
                   WHEN l_orderkey % 7 = 1 THEN -0.5::DOUBLE - l_quantity/50::DOUBLE
                   WHEN l_orderkey % 83 = 1 THEN 1::DOUBLE + l_quantity/50::DOUBLE
                   ELSE l_quantity/50::DOUBLE END AS FLOAT) AS intensity,
         l_shipdate AS scanned_at
  FROM lineitem)"""

SCANS_V = """scans_v AS (
  SELECT o_orderkey // 1000 AS frame_id,
         o_orderkey % 1000 AS point_id,
         CAST(((o_orderkey*7919) % 44000)/1000::DOUBLE - 2::DOUBLE AS FLOAT) AS x,
         CAST(((o_custkey*6151 + o_orderkey*31) % 44000)/1000::DOUBLE - 22::DOUBLE AS FLOAT) AS y,
         CAST(((o_orderkey*389) % 1900)/1000::DOUBLE - 1.6::DOUBLE AS FLOAT) AS z,
         CAST((o_custkey % 997)/996::DOUBLE AS FLOAT) AS intensity
  FROM orders)"""

OBJECTS_V = """objects_v AS (
  SELECT CAST(s_suppkey % 7 + 1 AS INTEGER) AS frame_id,
         s_suppkey AS draw_ord,
         s_suppkey AS id,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE
           CASE s_suppkey % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'pedestrian'
                              WHEN 2 THEN 'cone' ELSE 'bus/coach (#2)' END END AS class_name,
         ((s_suppkey*7919) % 48000)/1000::DOUBLE - 4::DOUBLE AS x,
         ((s_suppkey*6151) % 48000)/1000::DOUBLE - 24::DOUBLE AS y,
         (s_suppkey % 9)/10::DOUBLE AS z,
         s_suppkey % 5 + 0.5::DOUBLE AS length,
         s_suppkey % 3 + 0.5::DOUBLE AS width,
         (s_suppkey % 63)/10::DOUBLE - 3.1::DOUBLE AS yaw
  FROM supplier)"""

FRAMES_V = "frames_v AS (SELECT s_suppkey AS frame_id, s_suppkey + 7 AS seed FROM supplier)"

# -- raster -------------------------------------------------------------------


def located(points: str) -> str:
    return f"""located AS (
  SELECT *,
         least(CAST(trunc((x - 0::FLOAT) / 0.1::FLOAT) AS INTEGER), 399) AS cell_row,
         least(CAST(trunc((y + 20::FLOAT) / 0.1::FLOAT) AS INTEGER), 399) AS cell_col
  FROM {points}
  WHERE x >= 0::FLOAT AND x < 40::FLOAT AND y >= -20::FLOAT AND y < 20::FLOAT)"""


MAXED = """maxed AS (
  SELECT frame_id, cell_row, cell_col,
         greatest(0::FLOAT, max(intensity)) AS max_intensity
  FROM located WHERE intensity IS NOT NULL AND NOT isnan(intensity) GROUP BY ALL)"""

GRAY = """gray AS (
  SELECT frame_id, cell_row, cell_col,
         CAST(trunc(least(255::FLOAT, greatest(0::FLOAT, max_intensity * 255::FLOAT)))
              AS INTEGER) AS gray
  FROM maxed)"""


def grays(points: str, view: str) -> str:
    return ",\n".join((view, located(points), MAXED, GRAY))


# -- hashed draws ---------------------------------------------------------------
# XXH64 of one 8-byte value, chained over the keys. DuckDB refuses a 64-bit
# overflow, so sums and products modulo 2^64 are taken by 32-bit halves.

# The XXH64 primes.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261

LOW = (1 << 32) - 1


def _u(value: int) -> str:
    return f"{value}::UBIGINT"


def _times(value: str, factor: int) -> str:
    low, high = factor & LOW, factor >> 32
    return (
        f"((((({value} & {_u(LOW)}) * {_u(low)}) >> 32)"
        f" + ((({value} & {_u(LOW)}) * {_u(high)}) & {_u(LOW)})"
        f" + ((({value} >> 32) * {_u(low)}) & {_u(LOW)})) & {_u(LOW)}) * {_u(1 << 32)}"
        f" + ((({value} & {_u(LOW)}) * {_u(low)}) & {_u(LOW)})"
    )


def _plus(value: str, addend: int) -> str:
    low, high = addend & LOW, addend >> 32
    carry = f"((({value} & {_u(LOW)}) + {_u(low)}) >> 32)"
    return (
        f"((({value} >> 32) + {_u(high)} + {carry}) & {_u(LOW)}) * {_u(1 << 32)}"
        f" + ((({value} & {_u(LOW)}) + {_u(low)}) & {_u(LOW)})"
    )


def _rotate_left(value: str, bits: int) -> str:
    kept = (1 << (64 - bits)) - 1
    return f"(({value} & {_u(kept)}) * {_u(1 << bits)} + ({value} >> {64 - bits}))"


def _mixed(value: str, bits: int) -> str:
    return f"xor({value}, {value} >> {bits})"


def hashed(result: str, source: str, name: str, *keys: tuple[str, str, str]) -> str:
    """CTEs that end in `result`: `source` with the hash of one BIGINT per
    (column to add, key, hash to start from), each step in a SELECT of its own
    so that no expression is repeated inside another."""
    word = "(CAST({} AS HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT"
    steps = [[f"*, CAST({word.format(key)} AS UBIGINT) AS {out}_w" for out, key, _ in keys]]
    for build in (
        lambda out, seed: _times(f"{out}_w", P2),
        lambda out, seed: _rotate_left(f"{out}_w", 31),
        lambda out, seed: _times(f"{out}_w", P1),
        lambda out, seed: f"xor({_plus(seed, (P5 + 8) % 2**64)}, {out}_w)",
        lambda out, seed: _rotate_left(f"{out}_w", 27),
        lambda out, seed: _times(f"{out}_w", P1),
        lambda out, seed: _plus(f"{out}_w", P4),
        lambda out, seed: _mixed(f"{out}_w", 33),
        lambda out, seed: _times(f"{out}_w", P2),
        lambda out, seed: _mixed(f"{out}_w", 29),
        lambda out, seed: _times(f"{out}_w", P3),
    ):
        steps.append([f"{build(out, seed)} AS {out}_w" for out, _, seed in keys])
    replaced = [
        "SELECT *, " + ", ".join(item.removeprefix("*, ") for item in steps[0])
    ] + ["SELECT * REPLACE (" + ", ".join(step) + ")" for step in steps[1:]]
    working = ", ".join(f"{out}_w" for out, _, _ in keys)
    replaced.append(
        f"SELECT * EXCLUDE ({working}), "
        + ", ".join(f"{_mixed(f'{out}_w', 32)} AS {out}" for out, _, _ in keys)
    )
    ctes = []
    for number, select in enumerate(replaced):
        last = number == len(replaced) - 1
        target = result if last else f"{name}_{number}"
        ctes.append(f"{target} AS ({select} FROM {source})")
        source = target
    return ",\n".join(ctes)


def signed(name: str) -> str:
    return (
        f"CAST(CASE WHEN {name} >= {_u(1 << 63)} "
        f"THEN CAST({name} AS HUGEINT) - 18446744073709551616::HUGEINT "
        f"ELSE CAST({name} AS HUGEINT) END AS BIGINT)"
    )


SPARK_HASH_SEED = _u(42)


def draws(blocks: str) -> str:
    """Adds sample and u0..u3 to blocks(frame_id, seed, block, points, ...)."""
    units = ", ".join(
        f"CAST(h{axis} >> 11 AS DOUBLE) * (1::DOUBLE / 9007199254740992::DOUBLE) AS u{axis}"
        for axis in range(4)
    )
    return ",\n".join(
        (
            hashed("seed_keys", blocks, "s", ("hs", "seed", SPARK_HASH_SEED)),
            hashed("frame_keys", "seed_keys", "f", ("hf", "frame_id", "hs")),
            hashed("block_keys", "frame_keys", "b", ("hb", "block", "hf")),
            f"block_roots AS (SELECT *, {signed('hb')} AS block_key FROM block_keys)",
            hashed("block_starts", "block_roots", "r", ("hk", "block_key", SPARK_HASH_SEED)),
            "samples AS (SELECT *, unnest(range(CAST(points AS BIGINT))) AS sample "
            "FROM block_starts)",
            hashed("sample_keys", "samples", "p", ("hp", "sample", "hk")),
            f"point_roots AS (SELECT *, {signed('hp')} AS point_key FROM sample_keys)",
            hashed("point_starts", "point_roots", "q", ("hq", "point_key", SPARK_HASH_SEED)),
            hashed(
                "axis_hashes",
                "point_starts",
                "x",
                *((f"h{axis}", str(axis), "hq") for axis in range(4)),
            ),
            f"drawn AS (SELECT *, {units} FROM axis_hashes)",
        )
    )


def _stretch(unit: str, low: float, high: float) -> str:
    return f"CAST({low!r}::DOUBLE + {high - low!r}::DOUBLE * {unit} AS FLOAT)"


BACKGROUND_COLUMNS = ", ".join(
    f"{_stretch(f'u{axis}', *BACKGROUND_RANGES[name])} AS {name}"
    for axis, name in enumerate(("x", "y", "z", "intensity"))
)
LOCAL = (
    "(-length/2 + (length/2 - (-length/2)) * u0)",
    "(-width/2 + (width/2 - (-width/2)) * u1)",
)
BOX_COLUMNS = f"""CAST(x + cos(yaw) * {LOCAL[0]} - sin(yaw) * {LOCAL[1]} AS FLOAT) AS x,
         CAST(y + sin(yaw) * {LOCAL[0]} + cos(yaw) * {LOCAL[1]} AS FLOAT) AS y,
         {_stretch('u2', *OBJECT_Z_RANGE)} AS z,
         {_stretch('u3', *OBJECT_INTENSITY_RANGE)} AS intensity"""

COUNT = (
    "CASE class_name "
    + " ".join(f"WHEN '{n}' THEN {c}" for n, c in POINTS_BY_CLASS.items())
    + f" ELSE {POINTS_OTHER_CLASS} END"
)

SCENE = (
    "scene(draw_ord, id, class_name, x, y, z, length, width, yaw) AS (VALUES "
    + ", ".join(
        f"({at}, {row[0]}::BIGINT, '{row[1]}', "
        + ", ".join(f"{v!r}::DOUBLE" for v in row[2:])
        + ")"
        for at, row in enumerate(SCENE_OBJECTS)
    )
    + ")"
)

# -- sequential draws -------------------------------------------------------------
# The permuted congruential generator with 128-bit state and its seeding, as in
# NumPy's default generator. A number's place n in the stream needs the n-th
# power of the step, which is the same for every seed: powers are built once,
# by doubling, and joined to the frames.

# Multiplier of the step, constants of the seeding.
STEP = 47026247687942121848144207491837523525
HASH_A, HASH_A_STEP = 0x43B0D7E5, 0x931E8875
HASH_B, HASH_B_STEP = 0x8B51F9DD, 0x58F38DED
MIX_LEFT, MIX_RIGHT = 0xCA01F9DD, 0x4973F715

WORD, WIDE = 1 << 32, 1 << 64


def _big(value: int) -> str:
    return f"{value}::UHUGEINT"


def _chain(source: str, columns: list[str]) -> str:
    """A subquery that adds the columns one by one, each in a SELECT of its own,
    so that no expression is repeated inside another."""
    for column in columns:
        source = f"(SELECT *, {column} FROM {source})"
    return source


def _product(name: str, x: str, y: str) -> list[str]:
    """Columns that end in `name`, x * y modulo 2^128; x and y are prefixes of
    columns x_hi, x_lo, y_hi, y_lo that hold 64 bits each."""
    wide = _big(WIDE)
    return [
        f"{x}_lo * {y}_lo AS {name}_ll",
        f"(({x}_hi * {y}_lo) % {wide} + ({x}_lo * {y}_hi) % {wide} + {name}_ll // {wide}) % {wide} "
        f"AS {name}_hi",
        f"{name}_ll % {wide} AS {name}_lo",
    ]


def _total(name: str, x: str, y: str) -> list[str]:
    """The same for x + y."""
    wide = _big(WIDE)
    return [
        f"{x}_lo + {y}_lo AS {name}_sum",
        f"({x}_hi + {y}_hi + {name}_sum // {wide}) % {wide} AS {name}_hi",
        f"{name}_sum % {wide} AS {name}_lo",
    ]


def _halves(name: str, value: int) -> str:
    return f"{_big(value // WIDE)} AS {name}_hi, {_big(value % WIDE)} AS {name}_lo"


def step_powers(numbers: int) -> str:
    """powers(n, a_hi, a_lo, c_hi, c_lo): n steps take a state s to a * s + c * inc."""
    ctes = [f"jump0 AS (SELECT 0::BIGINT AS n, {_halves('a', 1)}, {_halves('c', 0)})"]
    level, factor, offset = 0, STEP, 1
    while 1 << level < numbers:
        columns = [f"{_halves('f', factor)}, {_halves('g', offset)}"]
        columns += [*_product("p", "a", "f"), *_product("q", "c", "f"), *_total("t", "q", "g")]
        ctes.append(
            f"""jump{level + 1} AS (
  SELECT n, a_hi, a_lo, c_hi, c_lo FROM jump{level}
  UNION ALL
  SELECT n + {1 << level}, p_hi, p_lo, t_hi, t_lo FROM {_chain(f"jump{level}", columns)})"""
        )
        offset = (offset * factor + offset) % (1 << 128)
        factor = factor * factor % (1 << 128)
        level += 1
    ctes.append(f"powers AS (SELECT * FROM jump{level} WHERE n BETWEEN 1 AND {numbers})")
    return ",\n".join(ctes)


def start_states() -> str:
    """starts: frames_v with the state s and increment i of each seed."""
    columns: list[str] = []
    word = _u(WORD)

    def hashed_word(name: str, value: str, before: int, after: int) -> None:
        columns.append(f"(xor({value}, {_u(before)}) * {_u(after)}) % {word} AS {name}_m")
        columns.append(f"xor({name}_m, {name}_m >> 16) AS {name}")

    constant, number = HASH_A, 0

    def next_word(name: str, value: str) -> None:
        nonlocal constant
        before, constant = constant, constant * HASH_A_STEP % WORD
        hashed_word(name, value, before, constant)

    columns.append(f"CAST(seed AS UBIGINT) % {word} AS e0")
    columns.append(f"CAST(seed AS UBIGINT) // {word} AS e1")
    pool = []
    for i in range(4):
        next_word(f"k{i}", f"e{i}" if i < 2 else _u(0))
        pool.append(f"k{i}")
    for source in range(4):
        for target in range(4):
            if source == target:
                continue
            number += 1
            next_word(f"h{number}", pool[source])
            columns.append(
                f"({_u(MIX_LEFT)} * {pool[target]} % {word} + {word} "
                f"- {_u(MIX_RIGHT)} * h{number} % {word}) % {word} AS x{number}_m"
            )
            columns.append(f"xor(x{number}_m, x{number}_m >> 16) AS x{number}")
            pool[target] = f"x{number}"
    constant = HASH_B
    for i in range(8):
        before, constant = constant, constant * HASH_B_STEP % WORD
        hashed_word(f"o{i}", pool[i % 4], before, constant)
    for i, name in enumerate(("w_hi", "w_lo", "v_hi", "v_lo")):
        columns.append(f"CAST(o{2 * i} + o{2 * i + 1} * {word} AS UHUGEINT) AS {name}")
    # inc = 2 v + 1; the state starts as (w + inc) * STEP + inc.
    columns.append(f"(v_hi * 2 + v_lo // {_big(1 << 63)}) % {_big(WIDE)} AS i_hi")
    columns.append(f"(v_lo * 2 + 1) % {_big(WIDE)} AS i_lo")
    columns += _total("y", "w", "i")
    columns.append(_halves("f", STEP))
    columns += _product("z", "y", "f")
    columns += _total("s", "z", "i")
    return f"starts AS (SELECT frame_id, s_hi, s_lo, i_hi, i_lo FROM {_chain('frames_v', columns)})"


def sequential_draws() -> str:
    """drawn(frame_id, block, point_id, u0..u3): every number of each stream is
    assigned to its block, axis and point."""
    sizes = [BACKGROUND_POINTS] + [
        POINTS_BY_CLASS.get(row[1], POINTS_OTHER_CLASS) for row in SCENE_OBJECTS
    ]
    begins = [sum(sizes[:i]) for i in range(len(sizes))]
    blocks = ", ".join(f"({i}, {b}, {n})" for i, (b, n) in enumerate(zip(begins, sizes)))
    numbers = 4 * sum(sizes)
    units = ", ".join(f"max(u) FILTER (axis = {axis}) AS u{axis}" for axis in range(4))
    columns = [*_product("p", "a", "s"), *_product("q", "c", "i"), *_total("r", "p", "q")]
    # Halves folded by xor, then turned right by the state's top six bits.
    columns += [
        "CAST(xor(CAST(r_hi AS UBIGINT), CAST(r_lo AS UBIGINT)) AS UHUGEINT) AS folded",
        f"CAST({_u(1)} << CAST(r_hi // {_big(1 << 58)} AS UBIGINT) AS UHUGEINT) AS turn",
    ]
    rotated = f"(folded // turn + (folded % turn) * ({_big(WIDE)} // turn))"
    return f"""{step_powers(numbers)},
{start_states()},
blocks(block, block_start, points) AS (VALUES {blocks}),
places AS (
  SELECT a_hi, a_lo, c_hi, c_lo, block, (n - 1 - 4 * block_start) // points AS axis,
         block_start + (n - 1 - 4 * block_start) % points AS point_id
  FROM powers JOIN blocks ON n > 4 * block_start AND n <= 4 * (block_start + points)),
numbers AS (
  SELECT frame_id, block, axis, point_id,
         CAST({rotated} // 2048 AS DOUBLE) * (1::DOUBLE / 9007199254740992::DOUBLE) AS u
  FROM {_chain("(SELECT * FROM starts CROSS JOIN places)", columns)}),
drawn AS (
  SELECT frame_id, block, CAST(point_id AS BIGINT) AS point_id, {units} FROM numbers
  GROUP BY frame_id, block, point_id)"""


# -- boxes ----------------------------------------------------------------------

CORNERS = """corners AS (
  SELECT o.*, k.corner,
         x + cos(yaw) * (k.along * length/2) - sin(yaw) * (k.across * width/2) AS wx,
         y + sin(yaw) * (k.along * length/2) + cos(yaw) * (k.across * width/2) AS wy
  FROM objects_v o
  CROSS JOIN (VALUES (0, 1, 1), (1, 1, -1), (2, -1, -1), (3, -1, 1)) k(corner, along, across))"""

PIXELS = """pixels AS (
  SELECT *,
         CAST(trunc((wy + 20::DOUBLE) / 0.1::DOUBLE) AS INTEGER) AS px_col,
         CAST(trunc((wx - 0::DOUBLE) / 0.1::DOUBLE) AS INTEGER) AS px_row
  FROM corners)"""

COLORS = (
    "colors(class_name, b, g, r) AS (VALUES "
    + ", ".join(f"('{n}', {b}, {g}, {r})" for n, (b, g, r) in CLASS_COLORS.items())
    + ")"
)

COLORED = """colored AS (
  SELECT o.*, coalesce(c.b, 255) AS b, coalesce(c.g, 255) AS g, coalesce(c.r, 255) AS r
  FROM objects_v o LEFT JOIN colors c USING (class_name))"""

BOXES = ",\n".join((OBJECTS_V, CORNERS, PIXELS, COLORS, COLORED))

# -- lines ------------------------------------------------------------------------


def traced(name: str, lines: str, thickness: int) -> str:
    """All pixels of lines(frame_id, draw_ord, c0, r0, c1, r1), cut at the grid.
    A line that runs more along than across grows downwards, others sideways."""
    flat = "abs(c1 - c0) >= abs(r1 - r0)"
    return f"""{name} AS (
  SELECT frame_id, draw_ord, px_row, px_col FROM (
    SELECT frame_id, draw_ord,
           CAST(r0 + k * (r1 - r0) // steps + if({flat}, wide, 0) AS INTEGER) AS px_row,
           CAST(c0 + k * (c1 - c0) // steps + if({flat}, 0, wide) AS INTEGER) AS px_col
    FROM (SELECT *, unnest(range(steps + 1)) AS k
          FROM (SELECT *, greatest(abs(c1 - c0), abs(r1 - r0), 1) AS steps FROM {lines}))
    CROSS JOIN range({thickness}) t(wide))
  WHERE px_row BETWEEN 0 AND 399 AND px_col BETWEEN 0 AND 399)"""


EDGES = """edges AS (
  SELECT a.frame_id, a.draw_ord,
         CAST(a.px_col AS BIGINT) AS c0, CAST(a.px_row AS BIGINT) AS r0,
         CAST(b.px_col AS BIGINT) AS c1, CAST(b.px_row AS BIGINT) AS r1
  FROM pixels a JOIN pixels b
    ON a.frame_id = b.frame_id AND a.draw_ord = b.draw_ord
   AND b.corner = (a.corner + 1) % 4)"""

GLYPH_LINES = (
    "strokes(code, dc0, dr0, dc1, dr1) AS (VALUES "
    + ", ".join("({}, {}, {}, {}, {})".format(*s) for s in glyph_segments())
    + "),\nletters AS (\n"
    "  SELECT frame_id, draw_ord, px_col, px_row, place - 1 AS place, substr(label, place, 1) AS letter\n"
    "  FROM (SELECT *, unnest(range(1, length(label) + 1)) AS place\n"
    "        FROM (SELECT *, concat_ws(':', class_name, id) AS label FROM pixels WHERE corner = 0))),\n"
    "glyph_lines AS (\n"
    f"  SELECT frame_id, draw_ord, px_col + place * {ADVANCE} + dc0 AS c0, CAST(px_row AS BIGINT) + dr0 AS r0,\n"
    f"         px_col + place * {ADVANCE} + dc1 AS c1, CAST(px_row AS BIGINT) + dr1 AS r1\n"
    "  FROM letters JOIN strokes ON code = CASE WHEN unicode(letter) BETWEEN 32 AND 126 "
    f"THEN unicode(letter) ELSE {ord(FALLBACK)} END)"
)

OUTLINES = ",\n".join((BOXES, EDGES, traced("outlines", "edges", 2)))
LABELS = ",\n".join((GLYPH_LINES, traced("label_pixels", "glyph_lines", 1)))


def image(gray_ctes: str) -> str:
    """Final picture: the highest layer of each pixel."""
    return f"""{gray_ctes},
{OUTLINES},
{LABELS},
layers AS (
  SELECT frame_id, cell_row, cell_col, 0::BIGINT AS layer, gray AS b, gray AS g, gray AS r FROM gray
  UNION ALL
  SELECT p.frame_id, p.px_row, p.px_col, 2 * p.draw_ord + 1, c.b, c.g, c.r
  FROM outlines p JOIN colored c USING (frame_id, draw_ord)
  UNION ALL
  SELECT p.frame_id, p.px_row, p.px_col, 2 * p.draw_ord + 2, c.b, c.g, c.r
  FROM label_pixels p JOIN colored c USING (frame_id, draw_ord)),
shown AS (
  SELECT frame_id, cell_row, cell_col, arg_max(b, layer) AS b,
         arg_max(g, layer) AS g, arg_max(r, layer) AS r
  FROM layers GROUP BY ALL),
image AS (
  SELECT frame_id, CAST(399 - cell_col AS INTEGER) AS out_row, cell_row AS out_col,
         CAST(b AS INTEGER) AS b, CAST(g AS INTEGER) AS g, CAST(r AS INTEGER) AS r
  FROM shown)"""


def all_oracles() -> dict[str, str]:
    gray = grays("points_v", POINTS_V)
    object_blocks = f"""object_blocks AS (
  SELECT frame_id, draw_ord, x, y, length, width, yaw, 7::BIGINT AS seed,
         draw_ord + 1 AS block, {COUNT} AS points
  FROM objects_v)"""
    background_blocks = f"""background_blocks AS (
  SELECT frame_id, seed, 0::BIGINT AS block, {BACKGROUND_POINTS} AS points FROM frames_v)"""
    # The seed, frame, block hashes are shared by both parts of a frame, so a
    # single list of blocks serves both.
    frame_blocks = f"""frame_blocks AS (
  SELECT frame_id, seed, 0::BIGINT AS block, {BACKGROUND_POINTS} AS points, 0::HUGEINT AS block_start,
         NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS length, NULL::DOUBLE AS width,
         NULL::DOUBLE AS yaw
  FROM frames_v
  UNION ALL
  SELECT frame_id, seed, draw_ord + 1, {COUNT},
         {BACKGROUND_POINTS} + sum({COUNT}) OVER (PARTITION BY frame_id ORDER BY draw_ord) - {COUNT},
         x, y, length, width, yaw
  FROM frames_v CROSS JOIN scene)"""
    documents = (
        "SELECT CAST(frame_id AS VARCHAR) AS frame_id, row_number() OVER (PARTITION BY frame_id "
        "ORDER BY draw_ord) - 1 AS draw_ord, id, class_name, x, y, z, "
        "length, width, yaw FROM objects_v"
    )
    return {
        "roi_filter": f"WITH {POINTS_V},\n{located('points_v')}\n"
        "SELECT frame_id, x, y, intensity FROM located",
        "cell_index": f"WITH {POINTS_V},\n{located('points_v')}\n"
        "SELECT frame_id, x, y, cell_row, cell_col FROM located",
        "point_intensity": f"WITH {POINTS_V},\n{located('points_v')}\n"
        "SELECT frame_id, cell_row, cell_col, CAST(trunc(least(255::FLOAT, "
        "greatest(0::FLOAT, intensity * 255::FLOAT))) AS INTEGER) AS gray FROM located "
        "WHERE intensity IS NOT NULL AND NOT isnan(intensity)",
        "bev_max": f"WITH {POINTS_V},\n{located('points_v')},\n{MAXED}\nSELECT * FROM maxed",
        "bev_gray": f"WITH {gray}\nSELECT * FROM gray",
        "bev_dense": f"WITH {gray}\n"
        "SELECT f.frame_id, CAST(cr.v AS INTEGER) AS cell_row, CAST(cc.v AS INTEGER) AS cell_col, "
        "coalesce(g.gray, 0) AS gray\n"
        "FROM (SELECT DISTINCT frame_id FROM points_v) f\n"
        "CROSS JOIN range(400) cr(v) CROSS JOIN range(400) cc(v)\n"
        "LEFT JOIN gray g ON g.frame_id = f.frame_id AND g.cell_row = cr.v AND g.cell_col = cc.v",
        "bev_rotated": f"WITH {gray}\n"
        "SELECT frame_id, 399 - cell_col AS out_row, cell_row AS out_col, gray FROM gray",
        "bev_bgr": f"WITH {gray}\n"
        "SELECT frame_id, cell_row, cell_col, gray AS b, gray AS g, gray AS r FROM gray",
        "scene_objects": f"WITH {FRAMES_V},\n{SCENE}\n"
        "SELECT frame_id, scene.* FROM frames_v CROSS JOIN scene",
        "class_fanout": f"WITH {OBJECTS_V}\n"
        "SELECT frame_id, id, class_name, CAST(s.v AS INTEGER) AS sample FROM objects_v "
        f"JOIN range(1, 901) s(v) ON s.v <= {COUNT}",
        "background": f"WITH {FRAMES_V},\n{background_blocks},\n{draws('background_blocks')}\n"
        f"SELECT frame_id, sample AS point_id, {BACKGROUND_COLUMNS} FROM drawn",
        "box_samples": f"WITH {OBJECTS_V},\n{object_blocks},\n{draws('object_blocks')}\n"
        f"SELECT frame_id, draw_ord, sample, {BOX_COLUMNS} FROM drawn",
        "frame_union": f"WITH {FRAMES_V},\n{SCENE},\n{frame_blocks},\n{draws('frame_blocks')}\n"
        f"SELECT frame_id, sample AS point_id, {BACKGROUND_COLUMNS} FROM drawn WHERE block = 0\n"
        "UNION ALL\n"
        f"SELECT frame_id, CAST(block_start + sample AS BIGINT), {BOX_COLUMNS} FROM drawn WHERE block > 0",
        "sequential_frames": f"WITH {FRAMES_V},\n{SCENE},\n{sequential_draws()}\n"
        f"SELECT frame_id, point_id, {BACKGROUND_COLUMNS} FROM drawn WHERE block = 0\n"
        f"UNION ALL\nSELECT frame_id, point_id, {BOX_COLUMNS} "
        "FROM drawn JOIN scene ON block = draw_ord + 1",
        "box_corners": f"WITH {BOXES}\n"
        "SELECT frame_id, id, corner, round(wx, 6) AS wx, round(wy, 6) AS wy FROM corners",
        "box_pixels": f"WITH {BOXES}\nSELECT frame_id, id, corner, px_col, px_row FROM pixels",
        "class_colors": f"WITH {BOXES}\nSELECT frame_id, id, class_name, b, g, r FROM colored",
        "box_labels": f"WITH {BOXES}\n"
        "SELECT p.frame_id, p.draw_ord, p.px_col AS anchor_col, p.px_row AS anchor_row, "
        "concat_ws(':', p.class_name, p.id) AS label, c.b, c.g, c.r\n"
        "FROM pixels p JOIN colored c USING (id) WHERE p.corner = 0",
        "box_outline": f"WITH {OUTLINES}\n"
        "SELECT p.frame_id, p.draw_ord, c.b * 65536 + c.g * 256 + c.r AS bgr, p.px_row, p.px_col "
        "FROM outlines p JOIN colored c USING (frame_id, draw_ord)",
        "label_strokes": f"WITH {OUTLINES},\n{LABELS}\n"
        "SELECT p.frame_id, p.draw_ord, c.b * 65536 + c.g * 256 + c.r AS bgr, p.px_row, p.px_col "
        "FROM label_pixels p JOIN colored c USING (frame_id, draw_ord)",
        "painted_pixels": f"WITH {OUTLINES}\n"
        "SELECT p.frame_id, px_row, px_col, max(draw_ord) AS draw_ord, arg_max(b, draw_ord) AS b, "
        "arg_max(g, draw_ord) AS g, arg_max(r, draw_ord) AS r\n"
        "FROM outlines p JOIN colored c USING (frame_id, draw_ord) GROUP BY ALL",
        "annotated_image": f"WITH {image(gray)}\nSELECT * FROM image",
        "draw_on_bev": f"WITH {image(gray)}\nSELECT * FROM image",
        "stored_bev": f"WITH {gray}\nSELECT * FROM gray",
        "npz_roundtrip": f"WITH {SCANS_V}\n"
        "SELECT CAST(frame_id AS VARCHAR) AS frame_id, point_id, x, y, z, intensity FROM scans_v",
        "json_roundtrip": f"WITH {OBJECTS_V}\n{documents}",
        "json_lines_roundtrip": f"WITH {OBJECTS_V}\n{documents}",
        "png_image": f"WITH {image(grays('scans_v', SCANS_V))}\n"
        "SELECT CAST(frame_id AS VARCHAR) AS frame_id, out_row, out_col, b, g, r FROM image "
        "WHERE b + g + r > 0",
        "bev_stream": f"""WITH {POINTS_V},
{located('points_v')},
windowed AS (
  SELECT *, time_bucket(INTERVAL 30 DAY, scanned_at, TIMESTAMP '1970-01-01') AS window_start
  FROM located WHERE intensity IS NOT NULL AND NOT isnan(intensity))
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start,
       CAST(epoch(window_start) + 30 * 86400 AS BIGINT) AS window_end, frame_id, cell_row, cell_col,
       CAST(trunc(least(255::FLOAT, greatest(0::FLOAT, max(intensity) * 255::FLOAT))) AS INTEGER) AS gray
FROM windowed
GROUP BY ALL""",
        "visible_sides": f"WITH {OBJECTS_V},\n{SIDES.format(count=COUNT)},\n"
        f"{draws('side_blocks')},\n{SIDE_PLACES}\n"
        "SELECT frame_id, draw_ord, sample, side, CAST(x + cos(yaw) * lx - sin(yaw) * ly AS FLOAT) AS x,\n"
        "CAST(y + sin(yaw) * lx + cos(yaw) * ly AS FLOAT) AS y,\n"
        f"{_stretch('u2', *OBJECT_Z_RANGE)} AS z, {_stretch('u3', *OBJECT_INTENSITY_RANGE)} AS intensity\n"
        "FROM on_side",
        "ground_background": f"WITH {FRAMES_V},\n{background_blocks},\n{draws('background_blocks')},\n"
        f"flat AS (SELECT frame_id, seed, sample AS point_id, {BACKGROUND_COLUMNS} FROM drawn),\n"
        f"{ground_sql(hashed, SPARK_HASH_SEED)}\n"
        "SELECT frame_id, point_id, x, y, z, intensity FROM raised",
    } | box_oracles(POINTS_V, OBJECTS_V, SCANS_V)
