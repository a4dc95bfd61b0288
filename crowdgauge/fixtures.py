"""A small sample dictionary for the invented prose of the shared test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .constants import INDEX_SECTOR
from .operators.dictionary import Dictionary
from .session import small_table

# ticker, name, sector, asset_class, aliases, ambiguous, supersedes, quote_symbol
STOCKS = [
    ("THN", "Thon Works", "chips", None, ["thon", "thble"], ["ther"], [], None),
    ("ERN", "Erin Labs", "chips", None, ["erin"], ["eren", "edon"], [], None),
    ("ANE", "Anea Power", "energy", "", ["anea"], ["thor"], [], None),
    ("CI", "Cithly", "energy", None, ["thly"], ["eran"], [], None),
    ("ION", "Ion Group", "banks", "stock", ["ered"], ["thing"], [], None),
    ("QUE", "Queque", "banks", None, ["queque"], ["pour"], [], None),
    ("BRK", "Berk", "banks", None, ["of the", "onst"], [], [], None),
    ("DER", "Der Index", INDEX_SECTOR, None, ["ment"], ["erly"], [], None),
    ("ONX", "Onan Fund", "", "index", ["onan"], [], [], None),
    ("UNE", "Une Metal", "", "commodity", ["thou", "lé"], [], [], "UN=F"),
    ("NG", "Ng Coin", "", "crypto", ["elle"], ["anon"], [], None),
    ("ERA", "Era Max", "chips", None, ["erat"], [], ["THN", "QUE"], None),
    ("ACC", "Accent", "", None, ["ément"], ["ción"], [], None),
    ("ZZZ", "Silent", "chips", None, ["zzzq"], [], [], None),
]
CONTEXT_WORDS = ["from", "tion", "avec"]
COLLISIONS = ["CI", "ION", "DER"]
TRAPS = ["thon the", "erin of", "anea"]
TOPICS = [("wordy", ["thth", "thre"]), ("french", ["elle", "que"]), ("tilde", ["ñ"]),
          ("phrase", ["in the", "to be"]), ("english", ["en"])]
# ticker, added_at_ms, custom_keywords JSON
TRACKED = [("ERN", 1, '["src3", "thin"]'), ("QUE", 2, "[]"), ("ZZZ", 3, None), ("NEWT", 4, '["thed", "src5"]')]


def dictionary(spark: SparkSession) -> Dictionary:
    return Dictionary.from_rows(spark, STOCKS, CONTEXT_WORDS, COLLISIONS, TRAPS, TOPICS)


def tracked(spark: SparkSession):
    return small_table(spark, TRACKED, "ticker string, added_at_ms bigint, custom_keywords string")
