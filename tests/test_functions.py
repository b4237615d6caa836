from pyspark.sql import functions as F

from disputo.functions import parsing, scalars, vectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    r = one(
        spark, clean=scalars.clean_text(F.lit(" See https://x.y <b>é</b>[12]  now ok ")), none=scalars.clean_text(F.lit(None).cast("string")), slug=scalars.slug(F.lit("We should -- Ban X!")), words=scalars.token_count(F.lit("  a b\tc\n")), blank=scalars.token_count(F.lit("  ")),
        short=scalars.conciseness(F.lit("One two. Three four!")), nothing=scalars.conciseness(F.lit(" ")), noise=scalars.strip_model_noise(F.lit("<think>x\ny</think>```json\n{}\n```")),
    )
    assert (r.clean, r.none, r.slug, r.words, r.blank, r.short, r.nothing, r.noise) == ("See é now ok", "", "we_should_ban_x", 3, 0, 50.0, None, "{}")


def test_labels_and_formats(spark):
    r = one(
        spark, pro=scalars.stance_label(F.lit(1)), odd=scalars.stance_label(F.lit(5)), fmt=scalars.fmt(F.lit(0.12345)), dash=scalars.fmt(F.lit(None).cast("double")), half=scalars.half_up(F.lit(2.5)), pool=scalars.config_part(F.lit("pool100_k5"), "pool"), k=scalars.config_part(F.lit("pool100_k5"), "k"),
        pct=scalars.percent(F.lit(1), F.lit(8)), empty=scalars.percent(F.lit(0), F.lit(0)), label=scalars.range_label(F.lit(3), F.lit(9)), weight=scalars.positive_weight(F.lit(None).cast("double"), F.lit(-2.0)), listed=scalars.numbered_list(F.array(F.lit("x"), F.lit("y"))), g=scalars.gain(F.lit(3)),
    )
    assert (r.pro, r.odd, r.fmt, r.dash, r.half, r.pool, r.k, r.pct, r.empty, r.label, r.weight, r.listed, r.g) == ("PRO", None, "0.123", "-", 3, 100, 5, "12.5%", "(no data)", "3–9 args", 1.0, "1. x\n2. y", 7.0)


def test_percent_rounds_as_printf(spark):
    pairs = [(a, b) for b in (*range(1, 65), 400, 2000) for a in range(b + 1)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", scalars.percent("a", "b").alias("p")).collect()
    assert [r for r in rows if r.p != f"{r.a * 100.0 / r.b:.1f}%"] == []  # halves such as 6.25 and 31.25 go to the even digit, 0.15 and 0.35 by their exact value


def test_summary_round_trip(spark):
    rendered = scalars.render_summary({"STRONGEST_PRO": F.lit("a\nb"), "KEY_TENSION": F.lit("t")})
    r = one(spark, pro=scalars.summary_field(rendered, "STRONGEST_PRO"), con=scalars.summary_field(rendered, "STRONGEST_CON"), key=scalars.summary_field(rendered, "KEY_TENSION"))
    assert (r.pro, r.con, r.key) == ("a\nb", "", "t")


def test_parsing(spark):
    ab = [parsing.parse_ab(F.lit(x)) for x in ("Answer\nB. because", "A", "Although", "")]
    assert list(one(spark, **{f"x{i}": c for i, c in enumerate(ab)})) == ["B", "A", None, None]
    texts = ('x {"grades":[{"id":1,"grade":2}', '{"id": 1', "no braces", '```json\n{"id": 3, "grades": []}```')
    parsed = [parsing.parse_json_object(F.lit(x), "id int, grades array<struct<id:int,grade:int>>", list_recovery=True) for x in texts]
    got = list(one(spark, **{f"x{i}": c for i, c in enumerate(parsed)}))
    assert got[0].grades[0].grade == 2 and got[1] is None and got[2] is None and got[3].id == 3


def test_grades_need_coverage(spark):
    raw = ", ".join(f'{{"id": {i}, "grade": {i % 4}}}' for i in range(1, 9))
    df = spark.createDataFrame([("a", raw, 10), ("b", raw + ', {"id": 9, "grade": 1}, {"id": 9, "grade": 3}, {"id": 77, "grade": 1}', 10)], "r string, raw string, n int")
    got = {(x.r, x.id): x.grade for x in parsing.parse_grades(df, "r", "raw", "n").collect()}
    assert len(got) == 10 and got[("b", 9)] == 1 and got[("b", 10)] is None


def test_vectors(spark):
    a, b, zero = (F.array(*[F.lit(float(x)) for x in v]) for v in ((3, 4), (4, 3), (0, 0)))
    r = one(spark, d=vectors.dot(a, b), c=vectors.cosine(a, b), z=vectors.cosine(a, zero), u=vectors.usable(a, 2), w=vectors.usable(zero, 2), n=vectors.usable(F.array(F.lit(1.0), F.lit(float("nan"))), 2), m=vectors.usable(F.lit(None).cast("array<double>"), 2), s=vectors.softmax(zero))
    assert (r.d, r.c, r.z, r.u, r.w, r.n, r.m, r.s) == (24.0, 0.96, None, True, False, False, False, [0.5, 0.5])
