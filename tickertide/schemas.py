"""Column types of the stored tables, as DDL text for readers."""

PRICE_CSV = (
    "date DATE, volume DOUBLE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, `adj close` DOUBLE"
)
BARS = (
    "ticker STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "adj_close DOUBLE, volume BIGINT"
)
NEWS_RAW = (
    "rn BIGINT, url STRING, date_raw STRING, stock_symbol STRING, title STRING, article STRING"
)
NEWS_META = (
    "url_hash STRING, url STRING, tickers ARRAY<STRING>, article_index BIGINT, title STRING, "
    "date_raw STRING, ts TIMESTAMP_NTZ, posted_after_close BOOLEAN"
)
ARTICLES = ("article_index BIGINT, url STRING, article STRING")
SUMMARIES = ("article_index BIGINT, summary STRING")
ARTICLE_SENTIMENT = ("article_index BIGINT, sentiment DOUBLE, num_sentences INT")
DAILY_SENTIMENT = ("ticker STRING, date DATE, daily_sentiment DOUBLE, n_articles BIGINT")
CALENDAR = ("date DATE")
SCALERS = ("ticker STRING, mean ARRAY<DOUBLE>, scale ARRAY<DOUBLE>")
RUN_METRICS = ("run_id STRING, split STRING, ticker STRING, metric STRING, value DOUBLE")
