from crowdgauge.operators import dictionary as D
from crowdgauge.operators import matching as M
from crowdgauge.session import small_table

STOCKS = [
    ("NVDA", "英伟达", "chips", None, ["英伟达", "nvidia"], ["女大"], [], None),
    ("AAPL", "苹果", "tech", None, [], ["苹果"], [], None),
    ("ALL", "Allstate", "", None, [], [], [], None),
    ("BRK", "b", "", None, [], [], [], None),
    ("BRK.B", "b", "", None, [], [], [], None),
    ("X.BRK", "b", "", None, [], [], [], None),
    ("QQQ", "纳指", "ETF指数", None, ["纳斯达克"], [], [], None),
    ("TQQQ", "三倍", "", None, ["三倍纳斯达克"], [], ["QQQ"], None),
    ("SPY", "标普", "ETF指数", None, ["s&p 500"], [], [], None),
]


def found(spark, text, targeted=None, tracked=None):
    d = D.Dictionary.from_rows(spark, STOCKS, ["美股", "pe"], ["ALL"], ["女大学生"], [])
    t = small_table(spark, [("note", "1", "1", text, 5, targeted)],
                    "source_type string, source_id string, note_id string, text string, content_time_ms bigint, targeted string")
    return {r["ticker"]: r["match_basis"] for r in M.extract(t, d, tracked).collect()}


def test_safe_alias_and_symbol(spark):
    assert found(spark, "英伟达涨了") == {"NVDA": "safe_alias"}
    assert found(spark, "看好BRK和NVIDIA") == {"BRK": "ticker_symbol", "NVDA": "safe_alias"}
    assert found(spark, "BRKX xBRK brk") == {}


def test_longest_symbol_wins(spark):
    assert found(spark, "buy BRK.B now") == {"BRK.B": "ticker_symbol"}
    assert found(spark, "buy X.BRK now") == {"X.BRK": "ticker_symbol"}
    assert found(spark, "buy BRK.B and BRK.") == {"BRK.B": "ticker_symbol", "BRK": "ticker_symbol"}
    assert found(spark, "buy BRK.BX or aX.BRK") == {"BRK": "ticker_symbol"}


def test_ambiguous_needs_context_or_target(spark):
    assert found(spark, "苹果很好吃") == {}
    assert found(spark, "美股 苹果") == {"AAPL": "alias+context"}
    assert found(spark, "苹果很好", "AAPL") == {"AAPL": "targeted_search"}


def test_collision_symbol(spark):
    assert found(spark, "ALL in") == {}
    assert found(spark, "美股 ALL") == {"ALL": "ticker_symbol"}
    assert found(spark, "ALL in", "ALL") == {"ALL": "targeted_search"}


def test_latin_context_words_have_boundaries(spark):
    assert found(spark, "people 苹果") == {}
    assert found(spark, "the pe 苹果") == {"AAPL": "alias+context"}


def test_traps_and_supersedes(spark):
    assert found(spark, "美股 女大学生") == {}
    assert found(spark, "美股 女大学生 女大") == {"NVDA": "alias+context"}
    assert found(spark, "三倍纳斯达克") == {"TQQQ": "safe_alias"}


def test_multi_word_latin_and_width(spark):
    assert found(spark, "the S&P 500!") == {"SPY": "safe_alias"}
    assert found(spark, "ＮＶＩＤＩＡ") == {"NVDA": "safe_alias"}


def test_large_dictionary_path_gives_the_same(spark, monkeypatch):
    text = "美股 苹果 S&P 500 BRK 纳斯达克 nvidia"
    want = found(spark, text)
    monkeypatch.setattr(M, "inlined", lambda terms: (None, []))
    assert found(spark, text) == want and len(want) == 5


def test_tracked_keyword(spark):
    tracked = small_table(spark, [("NEWT", 1, '["新词"]')], "ticker string, added_at_ms bigint, custom_keywords string")
    assert found(spark, "美股 新词", None, tracked) == {"NEWT": "alias+context"}
