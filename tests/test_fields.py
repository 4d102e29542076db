"""Fields, formats, formulas, merges and counters against the values that the field language is defined by."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import pictures, values as V, words
from fieldloom.functions.culture import EN, culture
from fieldloom.lang.instruction import Format, comparison, parse, pieces, tokenize
from fieldloom.operators import cells, counters, merge
from fieldloom.plans.fields import Context, Evaluator

NOW = "2026-02-07 09:05:06"


def texts(spark, instructions, cached=None, **context):
    e = Evaluator(Context(now=F.lit(NOW).cast("timestamp"), **context))
    made = [e.field(i, None if cached is None else F.lit(cached)) for i in instructions]
    row = spark.range(1).select(*(f.column().alias(f"c{k}") for k, f in enumerate(made))).first()
    return [r.text if r.status == "Resolved" else (r.status, r.text) for r in row]


def formatted(value, switches, where=EN, invariant=False):
    v = V.number(float(value)) if isinstance(value, (int, float)) else V.text(value)
    return pictures.apply_formats(V.as_text(v, where), v, parse("X " + switches).formats, where, invariant)


FORMULAS = [
    ("= (A + B) * 2", "30"), ("= SUM(1, 2, 3)", "6"), ("= ROUND(3.14159, 2)", "3.14"), ("= 1 / 0", "!Zero Divide"), ("= LN(10)", "!Syntax Error, 10"),
    ("= AVERAGE(2, 4, 6)", "4"), ("= AVERAGE()", "0"), ("= COUNT(1, 2, 3, 4)", "4"), ("= COUNT()", "0"), ("= MOD(7, 3)", "1"), ("= MOD(7, 0)", "0"),
    ("= INT(3.9)", "3"), ("= INT(-3.1)", "-4"), ("= AND(1, 0, 3)", "0"), ("= OR(0, 0, 5)", "1"), ("= IF(0, 10, 5)", "5"), ("= TRUE(2)", "1"), ("= TRUE", "0"),
    ("= DEFINED(A)", "1"), ("= DEFINED(Unknown)", "0"), ("= DEFINED(1/0)", "0"), ("= 2 + 3 * 4", "14"), ("= 50% + 25", "25.5"), ("= -2^2", "4"), ("= 0-2^2", "-4"),
    ("= -(2^2)", "-4"), ("= 2------2", "4"), ("= ROUND()", "0"), ("= NOT()", "1"), ("= MOD(1)", "0"), ("= IF()", "0"), ("= 1 +", "!Syntax Error"), ("= IF(1, 2, 1/0)", "2"),
    ("= {IF A = 10 3 4} * 2", "6"), ("= 1 / 0 \\# 0.0", "!Zero Divide"), ("=1+1", "2"), ("= SUM(1; 2)", "!Syntax Error, ;"),
]


def test_formulas(spark):
    names = {"A": V.text("10"), "B": V.text("5")}
    assert list(zip([f for f, _ in FORMULAS], texts(spark, [f for f, _ in FORMULAS], bookmarks=names), strict=True)) == FORMULAS
    assert texts(spark, ["= SUM(1; 2; 3)"], list_separator=";") == ["6"]
    areas = {"A1": [2.0], "B1": [3.0], "A1:B1": [2.0, 3.0], "LEFT": [5.0, 7.0]}
    held = lambda a: F.array(*map(F.lit, areas[a])) if a in areas else None
    assert texts(spark, ["= A1 + B1", "= SUM(A1:B1)", "= SUM(LEFT)", "= MAX(LEFT, 6)", "= C9"], cells=held) == ["5", "5", "12", "7", "0"]


FORMATS = [
    (27, "\\* ALPHABETIC", "AA"), (9, "\\* roman", "ix"), (21, "\\* Ordinal", "21st"), (42, "\\* CardText", "forty-two"), (9, '\\# "00.00"', "09.00"), (222492, "\\# x##", "492"),
    (15, "\\# $###", "$ 15"), (1234.5, '\\# "$#,##0.00;-$#,##0.00;ZERO"', "$1,234.50"), (-1234.5, '\\# "$#,##0.00;-$#,##0.00;ZERO"', "-$1,234.50"), (0, '\\# "$#,##0.00;-$#,##0.00;ZERO"', "ZERO"),
    (1234567, '\\# "#,##0"', "1,234,567"), (1234567, '\\# "#,##x"', "   7"), (1234567, '\\# "#x#"', " 67"), (12, '\\# "0000"', "0012"), (12, '\\# "####"', "  12"),
    (12.3, "\\# \"'Tax:' 0.0%\"", "Tax: 12.3%"), (1.2, '\\# "0.##"', "1.2"), (1.0, '\\# "0.##"', "1"), (-3, "\\# 0", "3"), (1e20, "\\# 0", "100000000000000000000"),
    ("a\tbC d-e", "\\* Caps", "A\tBC D-e"), (" two words", "\\* FirstCap", " Two words"), (5, "\\* ArabicDash", "-5-"), (4000, "\\* Roman", "4000"), (2.5, "\\* Hex", "2"), ("x", "\\* Unknown", "X"),
]


def test_formats(spark):
    row = spark.range(1).select(*(formatted(v, f).alias(f"c{k}") for k, (v, f, _) in enumerate(FORMATS))).first()
    assert list(row) == [w for _, _, w in FORMATS]
    turkish, french = culture("tr-TR"), culture("fr-FR")
    more = [formatted("istanbul", "\\* Upper", turkish), formatted("istanbul", "\\* FirstCap", turkish), formatted("1,234.5", "\\* Hex", french), formatted("1,234.5", "\\* Hex", french, True)]
    t = F.lit(NOW).cast("timestamp")
    more += [pictures.date_picture(t, "ddd, MMM d 'at' h:mm AM/PM"), pictures.date_picture(t, "dddd d MMMM yyyy", french), V.as_text(V.date(t))]
    assert list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(more))).first()) == ["İSTANBUL", "İstanbul", "1,234.5", "4D2", "Sat, Feb 7 at 9:05 AM", "samedi 7 février 2026", "2/7/2026 9:05:06 AM +00:00"]


def test_number_texts(spark):
    cases = [(3.0, "3"), (0.1, "0.1"), (1e15, "1E+15"), (123456789012345.0, "123456789012345"), (1e-5, "1E-05"), (0.0001, "0.0001"), (-2.5, "-2.5"), (1.5e300, "1.5E+300"), (-1e-7, "-1E-07")]
    parsed = [("1,234.5", 1234.5), ("(5)", -5.0), ("$1,200", 1200.0), (" -3 ", -3.0), ("5-", -5.0), ("1e3", 1000.0), ("NaN", None), ("5d", None), ("", None), (".5", 0.5), ("--5", None), ("(5", None)]
    row = spark.range(1).select(*(V.number_text(F.lit(x)).alias(f"a{k}") for k, (x, _) in enumerate(cases)), *(V.parse_number(F.lit(x)).alias(f"b{k}") for k, (x, _) in enumerate(parsed))).first()
    assert list(row) == [w for _, w in cases] + [w for _, w in parsed]


def test_words_of_all_numbers(spark):
    """The look-up tables against the plain rules, on every number."""
    df = spark.range(words.MOST + 1).withColumnRenamed("id", "n")
    for name, lang in words.LANGUAGES.items():
        for make, say in ((words.cardinal, lang.cardinal), (words.ordinal, lang.ordinal)):
            got = {r.n: r.w for r in df.select("n", make(F.col("n"), name).alias("w")).collect()}
            assert got == {n: say(n) for n in range(words.MOST + 1)}, name
    row = spark.range(1).select(words.dollars(F.lit(1234.5)).alias("a"), words.dollars(F.lit(-0.999), "fr").alias("b"), words.cardinal(F.lit(-40000), "de").alias("c"), words.ordinal(F.lit(-3), "ja").alias("d")).first()
    assert list(row) == ["one thousand two hundred thirty-four and 50/100", "moins un et 00/100", "minus 40000", "第マイナス 三"]


def test_state_of_a_template(spark):
    got = texts(spark, ["SET x {= 2 + 3}", "REF x \\# 00", 'SET x "hi"', "x \\* Upper", "SEQ F", "SEQ F", "SEQ F \\c", "SEQ F Start", "SEQ F", "SEQ G \\h", "SEQ G", "SEQ H \\r 3", "SEQ H \\h", "SEQ H \\h \\* Arabic", "AUTONUM", "AUTONUM \\* Roman", "AUTONUM \\s-"], bookmarks={"Start": V.text("10")})
    assert got == ["5", "05", "hi", "HI", "1", "2", "2", "10", "11", "", "2", "3", "", "5", "1.", "II.", "3-"]
    assert texts(spark, ['FILLIN "Name?" \\d "dflt"', 'ASK bm "Q?" \\d z', "REF bm", 'FILLIN "Color?"'], answers={"Color?": F.lit("red")}) == ["dflt", "", "z", "red"]
    assert texts(spark, ["PAGE", "DOCVARIABLE v", "TOC", "NEXT"], cached="c", missing_variable="cache", use_cache=True) == [("UsedCache", "c")] * 3 + [""]
    assert texts(spark, ["GREETINGLINE", "ADDRESSBLOCK"], record={"Title": V.text("Dr."), "LastName": V.text("Smith"), "City": V.text("Springfield"), "State": V.text("IL"), "PostalCode": V.text("62704")}) == ["Dear Dr. Smith,", "SPRINGFIELD IL  62704"]


def test_instruction_parts():
    i = parse('IF Name = "x \\"y\\" {REF a \\* Upper}" "t" "" \\* Upper \\@ "d \'at\'" tail \\b "Dear " \\c')
    assert (i.type, i.tokens, i.switches) == ("IF", ["Name", "=", 'x "y" {REF a \\* Upper}', "t", ""], {"b": "Dear ", "c": None})
    assert i.formats == [Format("*", "Upper"), Format("@", "d 'at'")]
    assert tokenize('a "" "b c" {IF 1 = 1 "x" "y"} d') == ["a", "", "b c", '{IF 1 = 1 "x" "y"}', "d"]
    assert pieces("a {x {y}} b {z") == [(False, "a "), (True, "x {y}"), (False, " b {z")]
    assert comparison(["A", '="x', "t"], 3) == ["A", "=", '"x', "t"]


@pytest.mark.parametrize("rows", [200_000, 2, 1])
def test_merge_loop_over_blocks(spark, rows):
    df = spark.createDataFrame([(1, "Alpha", 1.0, 0.0), (2, "Beta", 0.0, 0.0), (3, "Gamma", 0.0, 1.0), (4, "Delta", 0.0, 0.0)], "id int, Name string, Flag double, Skip double")
    template = {"a": "MERGEFIELD Name", "n": "NEXTIF Flag = 1", "b": "MERGEFIELD Name", "s": "SKIPIF Skip = 1", "q": "MERGESEQ"}
    out = merge.merge(df, template, "id", rows_per_range=max(2, rows)).orderBy("mergerec").collect()
    assert [(r.a, r.b, r.q) for r in out] == [("Alpha", "Beta", "1"), ("Beta", "Beta", "2"), ("Delta", "Delta", "3")]
    ranged = merge.merge_records(df, "id", F.col("Skip") == 1, rows_per_range=rows).orderBy("id").collect()
    assert [(r.id, r.mergerec, r.mergeseq) for r in ranged] == [(1, 1, 1), (2, 2, 2), (4, 4, 3)]


def test_merge_starts_against_a_loop(spark):
    """Moves of 1 to 3 records, over blocks of a few, against following them one by one."""
    steps = [1 + (i * 7919 % 3) for i in range(200)]
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(steps)], "mergerec long, step int")
    want, at = [], 0
    while at < len(steps):
        want.append(at + 1)
        at += steps[at]
    for block in (4, 37, 1000):
        assert sorted(r.mergerec for r in merge.starts(df, "step", most=3, rows_per_block=block).collect()) == want


def test_counters(spark):
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate([0, 1, 0, 0, 2, 0, 2, 1])], "doc int, ord int, h int")
    got = {f: [r.autonum for r in counters.auto_numbers(df, ["doc"], ["ord"], F.col("h"), f).orderBy("ord").collect()] for f in ("AUTONUM", "AUTONUMLGL", "AUTONUMOUT")}
    assert got["AUTONUM"] == ["1.", "1.", "1.", "2.", "1.", "1.", "2.", "2."]
    assert got["AUTONUMLGL"] == ["1.", "1.", "1.1.", "1.2.", "1.1.", "1.1.1.", "1.2.", "2."]
    assert got["AUTONUMOUT"] == ["I.", "I.", "I.A.", "I.B.", "I.A.", "I.A.1.", "I.B.", "II."]
    q = spark.createDataFrame([(1, 1, 1, None), (1, 2, 1, None), (1, 3, 2, None), (1, 4, 2, None), (1, 5, 2, 10), (1, 6, 2, None)], "doc int, ord int, lv int, r int")
    assert [r.seq for r in counters.sequence(q, ["doc"], ["ord"], reset=F.col("r"), outline=F.col("lv")).orderBy("ord").collect()] == [1, 2, 1, 2, 10, 11]


def test_ranges():
    assert cells.parse_range("C3:A1") == (0, 0, 2, 2) and cells.parse_range("AA10") == (9, 26, 9, 26)
    assert cells.parse_range("A0") is None and cells.parse_range("A1:B2:C3") is None and cells.column_index("ZZ") == 702
