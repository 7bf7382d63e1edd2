import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curul.functions import dates, status, text, urls


def test_comparison_form(column):
    assert column(text.normalize_text, "  José  ÑÚÑEZ^ ", "Àé\n x", None) == ["jose nunez", "ae x", None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=20), min_size=20, max_size=40))
def test_comparison_form_agrees_with_unicode_tables(column, values):
    def plain(value):
        marks = set("^`¨¯´·¸")
        kept = [c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn" and c not in marks]
        return "".join(kept).lower()

    got = column(text.normalize_text, *values)
    for value, out in zip(values, got):
        expected = " ".join(plain(value).replace(" ", " ").split(" "))
        assert out.replace(" ", "") == "".join(c for c in expected if not c.isspace() or c == "\x85").replace(" ", "")


def test_cleaning(column):
    assert column(text.clean_title, " Ley  de aguas. ") == ["Ley de aguas"]
    assert column(text.clean_optional, "  ", " a  b ") == [None, "a b"]
    assert column(text.clean_text, "a &amp; b<br/>c", None) == ["a & b c", ""]
    assert column(text.strip_html, "<p>a</p><b>b</b>") == ["a b"]
    assert column(text.enumerated_list, "1.- Salud 2.- Justicia ", "Salud", "") == ["1.- Salud | 2.- Justicia", "Salud", None]
    assert column(text.capitalize_first, "por el que", "á") == ["Por el que", "Á"]


def test_word_xml(column):
    xml = '<w:p><w:r><w:t>[{"titulo":"Proyecto de </w:t></w:r><w:r><w:t>decreto","tipo":"iniciativa"}]</w:t></w:r></w:p>'
    assert column(text.word_xml_text, xml) == ['[{"titulo":"Proyecto de decreto","tipo":"iniciativa"}]']


def test_unique_keeps_first_spelling(spark):
    df = spark.createDataFrame([(["José", "JOSE", "Ana", "", "ana"],)], "v array<string>")
    assert df.select(text.unique_by("v").alias("o")).first().o == ["José", "Ana"]


def test_better_choices(spark):
    df = spark.createDataFrame([("abc", "abc", None), (None, "a", ""), ("abcd", "abc", "x")], "a string, b string, c string")
    rows = df.select(text.better_title("a", "b").alias("t"), text.better_description("b", "c").alias("d")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, True), (True, True)]


def test_dates(column):
    assert column(dates.any_date, "x 2020-01-02 y", "3/4/2021", "no") == ["2020-01-02", "2021-04-03", None]
    assert column(dates.long_date, "el 3 de Marzo de 2025", "3 de foo de 2025") == ["2025-03-03", None]
    assert column(dates.exact_slash_date, "01/02/2020", "1/2/2020") == ["2020-02-01", None]
    assert column(dates.exact_iso_date, "0000-00-00", " 2020-01-02 ") == [None, "2020-01-02"]
    assert column(dates.block_date, "a 3 de marzo de 2025 b 1 de enero de 2020") == ["2020-01-01"]
    assert column(dates.as_date, "2025-02-30") == [None]
    assert column(dates.status_date, "EL 12-ENE-2020", "12-ene-2020") == ["2020-01-12", None]
    assert column(dates.file_year, "a/iniciativas_proposiciones_2019.json", "b") == ["2019", "unknown"]


def test_addresses(column):
    base = F.lit("http://h.com/a/b.html?x=1")
    resolved = column(lambda c: urls.absolute_url(base, c), "/The", "c.html", "../d", "?q=1", "#f", "//w.com/x", "http://z.com")
    assert resolved == [
        "http://h.com/The", "http://h.com/a/c.html", "http://h.com/d", "http://h.com/a/b.html?q=1",
        "http://h.com/a/b.html?x=1", "http://w.com/x", "http://z.com/",
    ]
    results = "https://sil.gobernacion.gob.mx/resultadosNumeraliaIniciativas.php?Origen=1&Paginas=50&Reg=3"
    assert column(urls.results_key, results) == ["resultados:1::3:1"]
    assert "Paginas=15" in column(urls.results_url, results)[0]
    assert len(column(urls.seed_window, results)[0]) == 5
    assert column(urls.gazette_url, "158383", "https://x/y", "abc") == [
        "https://www.senado.gob.mx/66/gaceta_del_senado/documento/158383", "https://x/y", None,
    ]
    assert column(urls.local_file_url, "a/doc 158383.html", "a/b c.html") == [
        "https://www.senado.gob.mx/66/gaceta_del_senado/documento/158383", "local://senado-gaceta/b%20c.html",
    ]
    kinds = column(
        lambda c: urls.page_kind(c, F.lit(""), "gaceta_senado"),
        "https://www.senado.gob.mx/66/gaceta_del_senado/documento/1", "http://senado.gob.mx/66/gaceta_del_senado/2024_01_02/3", "http://other.com",
    )
    assert kinds == ["document", "session", None]


def test_status_rules(column):
    turn = "Turno directamente a la Comisión de Salud"
    assert column(lambda c: status.event_from_status(c, "gaceta_senado"), turn) == ["turn_to_commission"]
    assert column(lambda c: status.event_from_status(c, "sil"), turn, "Desechado", "Devuelto") == ["other", "rejection", "returned_with_changes"]
    assert column(lambda c: status.event_from_status(c, "senado_transparencia"), "En comisión") == ["turn_to_commission"]
    assert column(status.chamber_narrow, "Senado", "Cámara de Senadores") == [None, "senado"]
    assert column(status.chamber_wide, "Senado", "", "x") == ["senado", None, "otro"]


def test_status_comparison(spark):
    df = spark.createDataFrame(
        [("published_dof", "rejected"), ("presented", "in_commissions"), ("approved_origin", "presented"), ("unknown", "presented")],
        "a string, b string",
    )
    assert [r.o for r in df.select(status.compare_status("a", "b").alias("o")).collect()] == ["behind", "behind", "ahead", "incomparable"]
