"""Stroke letters for labels.

A glyph is drawn on a 5 x 9 lattice: x 0..4 to the right, y 0..8 upwards,
baseline at y = 2. Each word of a glyph is one polyline, two digits per vertex.
Printable ASCII has glyphs; any other
character is drawn as a question mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLYPHS = {
    " ": "",
    "!": "2824 2222",
    '"': "1816 3836",
    "#": "1812 3832 0646 0444",
    "$": "47380716053544331203 2820",
    "%": "0248 1807061708 3433423334",
    "&": "42173827041213244245",
    "'": "2826",
    "(": "38262432",
    ")": "18262412",
    "*": "2723 0746 0644",
    "+": "2723 0545",
    ",": "231211",
    "-": "0444",
    ".": "2222",
    "/": "0248",
    ":": "2525 2323",
    ";": "2525 231211",
    "<": "470543",
    "=": "0646 0444",
    ">": "074503",
    "?": "071838474624 2222",
    "@": "33251434334547381807031242",
    "[": "38181232",
    "\\": "0842",
    "]": "18383212",
    "^": "062846",
    "_": "0141",
    "`": "1826",
    "{": "3827260524233212",
    "|": "2820",
    "}": "18272645242312",
    "~": "0516253445",
    "0": "180703123243473818 1337",
    "1": "172822 1232",
    "2": "07183847460242",
    "3": "084825354443321203",
    "4": "380444 3832",
    "5": "4808053544433202",
    "6": "4818060312324344351504",
    "7": "084812",
    "8": "180706150403123243443546473818 1535",
    "9": "4635150607183847443202",
    "A": "022842 1434",
    "B": "02083847463505 3544433202",
    "C": "4738180703123243",
    "D": "02082846442202",
    "E": "48080242 0535",
    "F": "480802 0535",
    "G": "47381807031232434424",
    "H": "0802 4842 0545",
    "I": "1838 1232 2822",
    "J": "4843321203",
    "K": "0802 480542",
    "L": "080242",
    "M": "0208254842",
    "N": "02084248",
    "O": "180703123243473818",
    "P": "02083847463505",
    "Q": "180703123243473818 2442",
    "R": "02083847463505 2542",
    "S": "473818070615354443321203",
    "T": "0848 2822",
    "U": "080312324348",
    "V": "082248",
    "W": "0812253248",
    "X": "0842 4802",
    "Y": "082548 2522",
    "Z": "08480242",
    "a": "4642 4536160503123243",
    "b": "0802 0516364543321203",
    "c": "4536160503123243",
    "d": "4842 4536160503123243",
    "e": "04444536160503123243",
    "f": "38281712 0636",
    "g": "4641301001 4536160503123243",
    "h": "0802 0516364542",
    "i": "2622 2828",
    "j": "26211000 2828",
    "k": "0802 460442",
    "l": "2822",
    "m": "0602 05162522 25364542",
    "n": "0602 0516364542",
    "o": "160503123243453616",
    "p": "0600 0516364543321203",
    "q": "4640 4536160503123243",
    "r": "0602 051636",
    "s": "45361605143443321203",
    "t": "28233242 0646",
    "u": "0603123243 4642",
    "v": "062246",
    "w": "0612243246",
    "x": "0642 4602",
    "y": "0622 461000",
    "z": "06460242",
}
FALLBACK = "?"
BASELINE = 2
# Pixels per lattice unit, as a fraction; characters advance by whole pixels.
SCALE = (3, 2)
ADVANCE = 9


def _pixels(units: int) -> int:
    return int(units * SCALE[0] / SCALE[1])


def glyph_segments() -> list[tuple[int, int, int, int, int]]:
    """(code, c0, r0, c1, r1) relative to the text anchor, rows downwards."""
    segments = []
    for glyph, strokes in GLYPHS.items():
        for stroke in strokes.split():
            vertices = [
                (_pixels(int(stroke[i])), -_pixels(int(stroke[i + 1]) - BASELINE))
                for i in range(0, len(stroke), 2)
            ]
            segments.extend(
                (ord(glyph), *start, *end) for start, end in zip(vertices, vertices[1:])
            )
    return segments


def glyph_pixels() -> list[tuple[int, int, int]]:
    """(code, column, row) of the pixels of all strokes, relative to the anchor.
    Step k of a stroke of n steps is at trunc(k * delta / n) from its start; a
    pixel repeats where strokes meet."""
    pixels = []
    for code, c0, r0, c1, r1 in glyph_segments():
        steps = max(abs(c1 - c0), abs(r1 - r0), 1)
        for k in range(steps + 1):
            places = (a + int(k * (b - a) / steps) for a, b in ((c0, c1), (r0, r1)))
            pixels.append((code, *places))
    return pixels


def glyph_table(texts: DataFrame) -> DataFrame:
    """(code, dc, dr) of each pixel, from one literal."""
    words = " ".join(",".join(map(str, pixel)) for pixel in glyph_pixels())
    numbers = (
        f"cast(split_part(word, ',', {i}) as int) AS {name}"
        for i, name in enumerate(("code", "dc", "dr"), start=1)
    )
    one_row = texts.sparkSession.range(1, numPartitions=1)
    return one_row.selectExpr(f"explode(split('{words}', ' ')) AS word").selectExpr(*numbers)


def glyph_places(texts: DataFrame) -> DataFrame:
    """Pixels of the texts: other columns of `texts` plus row and col (BIGINT).

    `texts` has anchor_col, anchor_row (BIGINT; left end of the baseline) and
    label. The table of pixels is the constant above, so it is broadcast.
    """
    keep = [c for c in texts.columns if c not in ("anchor_col", "anchor_row", "label")]
    spelled = texts.selectExpr(
        *keep, "anchor_col", "anchor_row", "posexplode_outer(split(label, '')) AS (place, letter)"
    ).selectExpr(
        *keep,
        f"anchor_col + place * {ADVANCE} AS pen_col",
        "anchor_row AS pen_row",
        "CASE WHEN ascii(letter) BETWEEN 32 AND 126 THEN ascii(letter) "
        f"WHEN letter <> '' THEN {ord(FALLBACK)} END AS code",
    )
    return spelled.join(F.broadcast(glyph_table(texts)), "code").selectExpr(
        *keep, "pen_row + dr AS row", "pen_col + dc AS col"
    )
