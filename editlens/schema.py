"""Column names, table schemas and fixed value lists."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They define features, slices and file layouts, so they must
# stay as they are for results to be comparable.

LANGUAGE_CODES = [
    "ka", "lv", "ta", "ur", "eo", "lt", "sl", "hy", "hr", "sk", "eu", "et", "ms", "az", "da", "bg",
    "sr", "ro", "el", "th", "bn", "no", "hi", "ca", "hu", "ko", "fi", "vi", "uz", "sv", "cs", "he",
    "id", "tr", "uk", "nl", "pl", "ar", "fa", "it", "zh", "ru", "es", "ja", "de", "fr", "en",
]

CONTENT_TYPES = [
    "Argument", "Category", "Comment", "ExternalLink", "Gallery", "HTMLEntity", "Heading", "List",
    "Media", "Paragraph", "Punctuation", "Reference", "Section", "Sentence", "Table",
    "Table Element", "Template", "Text", "Text Formatting", "Whitespace", "Wikilink", "Word",
]

ACTION_TYPES = ["change", "insert", "move", "remove"]

TRUSTED_GROUPS = [
    "sysop", "oversight", "editor", "rollbacker", "checkuser", "abusefilter", "bureaucrat",
]

EDIT_TAGS = [
    "mobile edit", "mobile web edit", "visualeditor", "wikieditor", "mobile app edit",
    "android app edit", "ios app edit",
]

USER_GROUPS = [
    "editor", "trusted", "ipblock-exempt", "interface-admin", "sysop", "autoreview", "bureaucrat",
    "autopatrolled", "patroller", "rollbacker", "reviewer", "extendedconfirmed", "templateeditor",
    "uploader", "autoreviewer", "suppressredirect",
]

PLACEHOLDER_TEXTS = ["N/A", "NA", "n/a", "na", "None", "nan", "N/a"]

NODE_TYPES = ["Text", "Reference"]

SIMILARITY_THRESHOLD = 60
SCORE_THRESHOLD = 0.5
MISSING = -1
SEED = 42

# Extra per-edit features of the stacking experiment, nested in one struct.
EXTRA_FEATURES = [
    "user_groups", "page_seconds_since_previous_revision", "user_revision_count", "user_age",
    "page_age", "user_is_anonymous", "revision_text_bytes", "revision_text_bytes_diff",
    "has_comment", "quality_score", "parent_quality_score", "quality_change",
    "quality_change_range", "quality_range", "text_length", "parent_text_length",
    "reference_count", "parent_reference_count", "wikilink_count", "parent_wikilink_count",
    "category_count", "parent_category_count", "media_count", "parent_media_count",
    "heading_count", "parent_heading_count",
]
# ---------------------------------------------------------------------------

ID = "revision_id"
WIKI = "wiki_db"
KEYS = [WIKI, ID]
LABEL = "revision_is_identity_reverted"
PARENT = "revision_parent_id"
REVERTER = "revision_first_identity_reverting_revision_id"
REVERTER_REVERTED = "reverting_revision_is_reverted_revision"
REVERTER_GROUPS = "reverting_revision_event_user_groups"
TIMESTAMP = "event_timestamp"
TITLE = "page_title"
COMMENT = "event_comment"
ANONYMOUS = "is_anonymous"

HISTORY_COLUMNS = [
    WIKI, COMMENT, "event_user_text_historical", "event_user_is_bot_by",
    "event_user_is_anonymous", "event_user_groups",
    "event_user_seconds_since_previous_revision", ID, TITLE, "page_revision_count",
    "revision_text_bytes_diff", LABEL, TIMESTAMP, "revision_tags", PARENT, REVERTER,
]

TAG_FLAGS = [f"is_{t.replace(' ', '_')}" for t in EDIT_TAGS]
GROUP_FLAGS = [f"is_{g}" for g in USER_GROUPS]
USER_FEATURES = GROUP_FLAGS + [ANONYMOUS]
ACTION_FEATURES = [f"{a}_{t}" for t in CONTENT_TYPES for a in ACTION_TYPES]

COLLECTED_COLUMNS = [
    WIKI, COMMENT, "event_user_text_historical",
    "event_user_seconds_since_previous_revision", ID, TITLE, "page_revision_count",
    "revision_text_bytes_diff", LABEL, TIMESTAMP, PARENT, REVERTER, REVERTER_REVERTED,
    "is_reverted_by_good_user", *TAG_FLAGS,
]

FRAGMENT_STATS = [f"{v}_{a}" for a in ("max", "mean") for v in ("s_0", "s_1", "p_0", "p_1")]
FRAGMENT_KINDS = ["insert", "remove", "change"]
COMMENT_STATS = ["s_0", "s_1", "p_0", "p_1"]


def model_feature_name(name: str) -> str:
    """Name of a text feature as the classifier knows it: `insert_s_0_max` → `bert_insert_s0_max`."""
    if name == "title_s_0":
        return "bert_title_score"
    return "bert_" + name.replace("_s_", "_s").replace("_p_", "_p")


TEXT_FEATURES = [f"{k}_{s}" for k in FRAGMENT_KINDS for s in FRAGMENT_STATS]
COMMENT_FEATURES = [f"comment_{s}" for s in COMMENT_STATS]
FEATURE_RENAMES = {n: model_feature_name(n) for n in [*TEXT_FEATURES, *COMMENT_FEATURES, "title_s_0"]}
LEGACY_ACTION_RENAMES = {f"{t}_{a}": f"{a}_{t}" for t in CONTENT_TYPES for a in ACTION_TYPES}

BASE_FEATURES = [
    WIKI, "revision_text_bytes_diff", "is_mobile_edit", "is_mobile_web_edit", "is_visualeditor",
    "is_wikieditor", "is_ios_app_edit",
]


def feature_list(user_features: bool = True, text_features: bool = True, comments: bool = False) -> list[str]:
    """Input columns of the classifier, in order."""
    names = BASE_FEATURES + ACTION_FEATURES
    if text_features:
        names = names + [FEATURE_RENAMES[f"{k}_{s}"] for k in ("insert", "remove", "change") for s in FRAGMENT_STATS]
        names = names + ["bert_title_score"]
    if comments:
        names = names + [FEATURE_RENAMES[c] for c in COMMENT_FEATURES]
    if user_features:
        names = names + USER_FEATURES
    return names


CATEGORICAL_FEATURES = [
    WIKI, "is_mobile_edit", "is_mobile_web_edit", "is_visualeditor", "is_wikieditor",
    "is_ios_app_edit", *USER_FEATURES,
]

CHANGE_PAIR = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
CHANGE_PAIRS = T.ArrayType(CHANGE_PAIR)

SCORES_MAP = T.MapType(
    T.StringType(),
    T.StructType([
        T.StructField("prediction", T.ArrayType(T.StringType())),
        T.StructField("probability", T.MapType(T.StringType(), T.DoubleType())),
    ]),
)

REVISION_CSV = T.StructType([
    T.StructField(WIKI, T.StringType()),
    T.StructField(COMMENT, T.StringType()),
    T.StructField("event_user_text_historical", T.StringType()),
    T.StructField("event_user_seconds_since_previous_revision", T.LongType()),
    T.StructField(ID, T.LongType()),
    T.StructField(TITLE, T.StringType()),
    T.StructField("page_revision_count", T.LongType()),
    T.StructField("revision_text_bytes_diff", T.LongType()),
    T.StructField(LABEL, T.IntegerType()),
    T.StructField(TIMESTAMP, T.TimestampNTZType()),
    T.StructField(PARENT, T.LongType()),
    T.StructField(REVERTER, T.LongType()),
    T.StructField(REVERTER_REVERTED, T.BooleanType()),
    T.StructField("is_reverted_by_good_user", T.IntegerType()),
    *[T.StructField(f, T.IntegerType()) for f in TAG_FLAGS],
    # lists written as literals; functions.text decodes them
    *[T.StructField(f, T.StringType()) for f in ("texts_removed", "texts_insert", "texts_change", "actions")],
])

SCORES_CSV = T.StructType([
    T.StructField(WIKI, T.StringType()),
    T.StructField(ID, T.LongType()),
    T.StructField("predict_score", T.DoubleType()),
])
