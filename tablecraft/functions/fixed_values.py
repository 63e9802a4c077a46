"""Constants that results depend on, kept together and in plain text."""

# Ordered name rules (pattern, concept, confidence); the first hit wins.
TAG_RULES = [
    (r".*_id$|^id$", "identifier", 0.95),
    (r".*_at$|.*_date$|^date.*|.*date$", "date", 0.95),
    (r".*email.*", "email", 0.98),
    (r".*phone.*|.*mobile.*", "phone_number", 0.95),
    (r".*customer.*|.*client.*|.*cust.*", "customer_identifier", 0.92),
    (r".*name.*", "name", 0.90),
    (r".*amount.*|.*price.*|.*salary.*|.*revenue.*|.*total.*", "financial_value", 0.90),
    (r".*address.*|.*street.*|.*city.*|.*zip.*", "address", 0.88),
    (r".*status.*|.*state.*", "status", 0.85),
    (r".*count.*|.*qty.*|.*quantity.*", "metric", 0.85),
]

# Configuration keys whose values are masked, and the two masks.
SECRET_KEYS = [
    "password", "api_key", "access_token", "private_key", "key", "access_key",
    "secret", "secret_key", "token", "client_secret",
]
SECRET_MASK = "************"
URL_PASSWORD_PATTERN = r"(\b\w+://[^:]+:)[^@]+(@)"
URL_PASSWORD_MASK = "*****"

# Separator and prefixes of a pipeline's printed log lines.
LOG_SEPARATOR = " |+| "
LOG_TAG = "[PIPELINE_LOG]:"
WARNING_PREFIX = "RUNTIME_WARNING:"
ERROR_PREFIXES = ["RUNTIME_ERROR:", "ERROR:"]
DROPPED_LEVEL_WORDS = ["DEBUG: ", "WARNING: "]

# Lines by which a run speaks to its runner; they are no log lines.
CONTROL_LINES = ["RUN_SUCCESSFULLY"]
CONTROL_PREFIXES = ["SHORT_QUERY=__e2e_short_query_:", "DATA=__dlt__destination__datasetname__:"]
NOISE = "import pkg_resources"

# Lines that end a run, the first of them as a log line of its own, marks of step lines, and a warning of the database layer.
FATAL_PREFIX = "ERROR:"
END_LINES = ["RUN_SUCCESSFULLY"]
END_PREFIXES = ["DATA=__dlt__destination__datasetname__:"]
STEP_PREFIX = "dynamic-_cmp"
STEP_SUFFIX = "Transformation"
TABLE_WARNING = r"(?i:SAWarning): (?i:Table) ['\"](.+?)['\"] (?i:already)"

# Keys of the list of source and destination types, with their columns.
ENDPOINT_KEYS = {
    "sourceType": "source_type", "destType": "dest_type", "pipeline": "pipeline",
    "sourceSecretName": "source_secret_name", "destSecretName": "dest_secret_name",
    "destinationConfig": "destination_config", "referencedSecrets": "referenced_secrets",
    "datasetName": "dataset_name",
}

# Ids of non-user log sources, no-op filter labels, and completion marks.
INTERNAL_LOG_IDS = ["system", "flask_server"]
ALL_LABELS = {
    "pipeline_id": "All Pipelines",
    "execution_id": "All Runs",
    "log_level": "All Levels",
}
COMPLETION_STAGE = "pipeline_completion"
FINISHED = "finished"

# Patterns of progress lines such as "orders: 120 |".
PROGRESS_LINE = r"^[a-z_]+:[ ]+[0-9]+[ ]+\|"
PROGRESS_NAME = r"^([a-z_]+):[ ]+[0-9]+"
PROGRESS_COUNT = r"^[a-z_]+:[ ]+([0-9]+)"

# Column names that look like dates or times.
DATE_LIKE_COLUMNS = r"(?i).*(date|time|ts).*"

# Source types read as text or as a plain timestamp.
TEXT_READ_TYPES = ["hierarchyid", "geometry", "geography", "xml"]

# Names of system tables and columns, and of staging schemas.
SYSTEM_PREFIX = "_dlt_"
STAGING_SUFFIX = "_staging"

# Technical table prefixes kept out of table trees, at the root, at each
# later step, and on both ends of a relation.
TREE_ROOT_EXCLUDES = [
    "ir_", "base_", "mail_", "bus_", "report_", "sms_", "snailmail_", "calendar_",
    "spreadsheet_", "web_", "wizard_", "portal_", "l10n_", "digest_", "res_",
]
TREE_STEP_EXCLUDES = [
    "ir_", "base_", "mail_", "bus_", "sms_", "snailmail_", "calendar_", "web_",
    "spreadsheet_", "portal_", "l10n_", "digest_", "report_", "wizard_", "res_",
]
RELATION_EXCLUDES = [
    "ir_", "base_", "mail_", "bus_", "sms_", "web_", "spreadsheet_", "digest_",
    "report_", "wizard_", "res_users", "res_groups", "auth_",
]

# Name patterns never shown as table or parent ("_" is any character).
TREE_HIDDEN = ["ir_%", "mail_%", "sms_%", "report_%", "l10n_%"]

# Module prefixes that are not business modules.
MODULE_EXCLUDES = [
    "IR", "BASE", "MAIL", "BUS", "REPORT", "SMS", "SNAILMAIL", "CALENDAR", "SPREADSHEET",
    "WEB", "WIZARD", "PORTAL", "L10N", "DIGEST", "AUTH", "AVATAR", "BARCODE", "BARCODES",
    "DECIMAL", "FETCHMAIL", "GOOGLE", "IAP", "IMAGE", "PHONE", "PRIVACY", "PUBLISHER",
    "RESOURCE", "SEQUENCE", "TEMPLATE", "UOM", "UTM", "RES", "WEB_EDITOR", "WEB_TOUR",
    "FORMAT", "UNKNOWN", "VENDOR", "BANK", "ANALYTIC", "ACCOUNT_FOLLOWUP", "PAYMENT",
    "RATING", "CRM_IAP", "BASE_IMPORT", "ONBOARDING",
]
