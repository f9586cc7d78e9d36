import random

from methyloom.operators import quarantine as quar

GOOD = ["c", "1", "2", "a", "9", "+", "1", "2", "255,0,0", "9", "11.1", "1", "8", "NA", "NA", "NA", "0", "NA"]


def line(**at):
    f = list(GOOD)
    for k, v in at.items():
        f[int(k[1:])] = v
    return "\t".join(f)


def scan(text):
    """Fields of a line by reading it character by character, or None if the quoting is broken."""
    fields, i = [], 0
    while True:
        if i < len(text) and text[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= len(text):
                    return None
                if text[i] == '"' and text[i + 1 : i + 2] == '"':
                    out, i = out + '"', i + 2
                elif text[i] == '"':
                    i += 1
                    break
                else:
                    out, i = out + text[i], i + 1
            fields.append(out)
            if i < len(text) and text[i] != "\t":
                return None
        else:
            end = text.find("\t", i)
            end = len(text) if end < 0 else end
            fields.append(text[i:end])
            i = end
        if i >= len(text):
            return fields
        i += 1


def broken(text):
    f = scan(text)
    number = lambda s: s.isascii() and s.isdigit() and int(s) <= 2147483647
    return f is None or len(f) != 18 or not (number(f[1]) and number(f[11]) and f[5] in ("+", "-") and f[3] in quar.MOD_SPELLINGS)


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")


def test_against_a_character_reader(spark):
    random.seed(7)
    lines = ["".join(random.choices('a"\t', [4, 3, 3], k=random.randrange(0, 12))) for _ in range(400)]
    for _ in range(400):
        f = list(GOOD)
        for _ in range(random.randrange(1, 4)):
            f[random.randrange(18)] = random.choice(['"x"', '"', '""', '"a\tb"', '"1"', "0001", "2147483648", "-1", "", "é", '"a""b"', 'a"b', '"x"y', "m", "+"])
        lines.append("\t".join(f))
    got = {r.line_id for r in quar.row_errors(frame(spark, lines), "line_id", "raw_line").collect()}
    assert got == {i for i, s in enumerate(lines) if broken(s)}


def test_reasons_and_edges(spark):
    lines = [
        line(), None, "", line(_1="x"), line(_11="2147483648"), line(_5="*", _3="b"), "\t".join(GOOD[:17]), line(_8='"255'), line(_17="NA\r"),
        "x\t" * 50_000, '"' + "a\t" * 50_000, line(_0='"' + "b" * 200_000 + '"'), line(_1="0" * 60 + "7"), line(_11="9" * 60), line(_1=" 1"), line(_1="1\n"),
    ]
    got = {r.line_id: r.reasons for r in quar.row_errors(frame(spark, lines), "line_id", "raw_line").collect()}
    assert got == {
        1: ["missing_line"], 2: ["wrong_field_count"], 3: ["invalid_position"], 4: ["invalid_n_mod"],
        5: ["invalid_mod_type", "invalid_strand"], 6: ["wrong_field_count"], 7: ["broken_quoting"], 9: ["wrong_field_count"],
        10: ["broken_quoting"], 13: ["invalid_n_mod"], 14: ["invalid_position"], 15: ["invalid_position"],
    }


def test_clean_records_keep_other_columns(spark):
    df = spark.createDataFrame([(1, line(_3='"m"', _9="x"), "f", 5), (2, line(_5="?"), "f", 6), (3, line(), None, None)], "line_id long, raw_line string, column string, position int")
    records, errors = quar.load_pileup(df)
    rows = {r.line_id: r for r in records.collect()}
    assert set(rows) == {1, 3} and [r.line_id for r in errors.collect()] == [2]
    assert (rows[1].mod_type, rows[1].n_valid_cov, rows[1].n_mod, rows[1]["column"], rows[1].position) == ("5mC", None, 1, "f", 1)


def test_empty_and_repeated_keys(spark):
    empty = frame(spark, [])
    assert quar.row_errors(empty, "line_id", "raw_line").count() == 0 and quar.load_pileup(empty)[0].count() == 0
    twice = spark.createDataFrame([(1, line()), (1, "bad"), (None, "bad"), (None, line()), (2, line())], "line_id long, raw_line string")
    records, errors = quar.load_pileup(twice)
    assert {r.line_id for r in records.collect()} == {1, None, 2} and records.count() == 3  # a failing row takes no sound one with it
    assert {(r.line_id, *r.reasons) for r in errors.collect()} == {(1, "wrong_field_count"), (None, "wrong_field_count")} and errors.count() == 2


def test_unsound_quotes_beyond_the_last_field_break_the_quoting(spark):
    lines = ["\t".join([*GOOD, '"a"b"']), "\t".join([*GOOD, '"a""b"']), "\t".join([*GOOD, "x", '"a\tb"c"'])]
    assert [scan(s) is None for s in lines] == [True, False, True]
    got = {r.line_id: r.reasons for r in quar.row_errors(frame(spark, lines), "line_id", "raw_line").collect()}
    assert got == {0: ["broken_quoting"], 1: ["wrong_field_count"], 2: ["broken_quoting"]}
