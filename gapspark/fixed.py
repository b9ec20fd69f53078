"""Texts, word lists, patterns and bounds that decide results.

These are data, not logic. They are spelled out once, here, in natural order.
"""

# --- gap labels and bounds (fixed values) -----------------------------------
LABEL_CRITICS = "Critics loved it, audiences didn't"
LABEL_AUDIENCE = "Audiences loved it, critics didn't"
LABEL_ALIGNED = "Aligned"
GAP_BOUND = 20
EXPLAIN_BOUND = 15
BADGE_BOUND = 5

# --- review windows and quotas (fixed values) -------------------------------
WINDOW_DAYS = 90
QUIET_DAYS = 14
BACKLOG_LIMIT = 200
DAILY_BACKLOG_LIMIT = 800
BACKFILL_BACKLOG_LIMIT = 950
DAILY_MIN_VOTES = 3
DAILY_MIN_POPULARITY = 5.0
BACKFILL_MIN_VOTES = 100
OVERVIEW_CHARS = 500
ARTICLE_CHARS = 6000
POSTER_PREFIX = "https://image.tmdb.org/t/p/w500"
CRITIC_SOURCE = "Rotten Tomatoes"
PROXY_SOURCE = "imdb"
BACKLOG_SOURCES = ("backfill", "tmdb")

REASON_NO_REVIEWS = "past 90-day window with no API reviews"
REASON_WENT_QUIET = "no new reviews for 14+ consecutive days"
REASON_NEVER_FOUND = "checked daily for 14+ days without finding reviews"

# --- headline patterns (fixed values; Java regular expressions) -------------
HEADLINE_LEAD = (
    r"^[Rr]eview\s*[:–\-]\s*['‘’“”]?(.+?)['‘’“”]?\s+"
    r"(?:is|are|has|have|was|were|offers|takes|gives|brings)"
)
HEADLINE_SEPARATORS = (" review", " – ", " - ", ": ")
HEADLINE_QUOTES = "'\"‘’“”"
HEADLINE_CHARS = 80

# Characters Python counts as white space, as a set and as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE_CLASS}+"
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"

# --- quotes (fixed values) --------------------------------------------------
QUOTE_MIN, QUOTE_MAX, QUOTES_SHOWN = 30, 200, 3
QUOTE_LEAD, QUOTE_OTHER, QUOTE_ANY = 12, 4, 10
LATEST_REVIEWS = 5

# --- explanation texts (fixed values; printf templates) ---------------------
EXPLAIN_NO_REVIEWS = (
    "Critics scored this film %d%% while audiences gave it %d%% — a %d-point gap. "
    "No critic reviews are stored yet, so we can't explain the specific reasons for the split."
)
EXPLAIN_AUDIENCE = (
    "Audiences rated this film %d points higher than critics. "
    "Of the %d critic reviews stored, %d (%d%%) are Rotten. "
    "Critics were broadly negative — the reviews below show what put them off. "
    "Audiences, however, gave it %d%%, suggesting they connected with "
    "the film on different terms than critics typically apply: "
    "subject matter, emotional impact, or personal relevance often matter more to "
    "general viewers than craft or objectivity."
)
EXPLAIN_CRITICS = (
    "Critics rated this film %d points higher than audiences. "
    "Of the %d critic reviews stored, %d (%d%%) are Fresh. "
    "Critics responded strongly to its qualities — the reviews below show what they valued. "
    "Audiences gave it only %d%%, which often happens when a film rewards "
    "patience, prior knowledge, or a taste for unconventional storytelling that broader "
    "audiences don't always share."
)
EXPLAIN_AGREE = (
    "Critics (%d%%) and audiences (%d%%) broadly agree on "
    "this film — the %d-point gap is within normal variation and doesn't represent "
    "a meaningful divergence."
)

# --- trend (fixed values) ---------------------------------------------------
TREND_MIN = 3
ROLLING_MONTHS = 3
Z_TWO_SIDED_5PCT = 1.959963984540054
WARN_NO_REVIEWS = "Data not loaded"
WARN_FEW_REVIEWS = "Not enough reviews for temporal analysis (need at least 3)"
WARN_BAD_DATES = "Too many unparseable review dates"

# --- text models (fixed values) ---------------------------------------------
MAX_FEATURES = 60000
FAST_WORDS = 500
DEEP_WORDS = 300
ASPECT_WORDS = 400
ASPECT_MIN_CONFIDENCE = 0.15
ASPECT_SENTENCE_MIN = 10
ASPECT_SENTENCES = 3
ASPECT_CHARS = 512
DISAGREEMENT_FACTOR = 0.82
RETRAIN_AT = 20
REPLAY_FACTOR, REPLAY_MAX = 5, 500
SPLIT_SEED = 42
MODEL_FAST, MODEL_DEEP = "tfidf_logistic", "naive_bayes"
MODEL_AGREE, MODEL_DISAGREE = "ensemble", "ensemble_disagreement"

# --- aspects and the word parts that point to them (fixed values) -----------
ASPECT_KEYWORDS = {
    "acting and performances": [
        "act", "perform", "cast", "actor", "actress", "role", "portray", "character", "star"],
    "plot and story": [
        "plot", "story", "narrative", "script", "storyline", "tale", "premise", "writing"],
    "pacing and editing": [
        "pac", "edit", "slow", "fast", "dragg", "rush", "brisk", "tight", "length", "too long"],
    "direction and filmmaking": [
        "direct", "film", "craft", "vision", "helmed", "helm", "auteur", "technique"],
    "visuals and cinematography": [
        "visual", "cinemat", "shot", "photograph", "look", "beauti", "gorgeous", "stunning",
        "camera"],
    "dialogue and writing": [
        "dialog", "dialogue", "line", "script", "writ", "speak", "verbal", "word"],
    "ending and resolution": [
        "end", "final", "conclus", "resolv", "finish", "last act", "climax", "third act"],
    "soundtrack and score": [
        "music", "score", "sound", "composit", "soundtrack", "track", "audio"],
}
