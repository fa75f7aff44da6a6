"""Fixed values of the event domain: names, word lists, thresholds and formats.

Everything here is data. The rules that use these values live in
``functions`` and ``operators``.
"""

# --- event vocabulary -------------------------------------------------------

SOURCE_TYPES = ("app", "k8s_audit", "falco")
SEVERITIES = ("info", "warning", "critical", "unauthorized_access")
WRITE_VERBS = ("create", "update", "patch", "delete")
AUTH_DENIED_CODES = (401, 403)

LEVEL_INFO = ("debug", "info", "notice")
LEVEL_WARNING = ("warn", "warning")
LEVEL_CRITICAL = ("error", "fatal", "critical", "panic", "alert", "emergency")

PRIORITY_INFO = ("debug", "informational", "info", "notice")
PRIORITY_WARNING = ("warning", "warn")
PRIORITY_CRITICAL = ("error", "critical", "alert", "emergency")

# --- audit classification ---------------------------------------------------

NODE_USER_PREFIX = "system:node:"
RBAC_RESOURCES = ("roles", "rolebindings", "clusterroles", "clusterrolebindings")
SECRET_RESOURCES = ("secrets",)
EXEC_SUBRESOURCES = ("exec", "attach", "portforward")
EXEC_PATHS = ("/exec", "/attach", "/portforward")
PRIVILEGE_RESOURCES = (
    "serviceaccounts", "serviceaccounts/token", "clusterrolebindings", "clusterroles",
)
WORKLOAD_RESOURCES = (
    "deployments", "statefulsets", "daemonsets", "replicasets", "pods", "namespaces",
)
CONFIG_RESOURCES = ("configmaps",)
WEBHOOK_RESOURCES = ("mutatingwebhookconfigurations", "validatingwebhookconfigurations")
DENIAL_WORDS = ("unauthorized", "forbidden")
KUBELET_CLASSES = ("kubelet_routine", "kubelet_status_reconciliation")

# --- application logs -------------------------------------------------------

APP_ERROR_WORDS = ("traceback", "exception", "error", "fatal", "panic")
APP_READ_METHODS = ("GET", "HEAD", "OPTIONS")
APP_RELEVANT_CLASSES = (
    "unauthorized_access",
    "application_server_error",
    "application_client_error",
    "application_error_signal",
    "application_mutation_or_action",
)
ACCESS_LOG_PATTERN = r'"([A-Z]+)\s+(/\S*)\s+HTTP/[^"]+"\s+(\d{3})'
LEVEL_WORDS_CRITICAL = ("critical", "panic", "fatal")
LEVEL_WORDS_ERROR = ("error", "exception", "traceback")
LEVEL_WORDS_WARNING = ("warn",)
APP_CONTAINERS = (
    "user-service", "product-service", "order-service", "payment-service",
    "notification-service",
)

# --- tags -------------------------------------------------------------------

# Looked for in lower-cased text.
TAG_PRIVILEGE = ("privilege", "sudo", "setuid", "cap_sys_admin", "root")
TAG_AUTH_FAILURE = ("unauthorized", "forbidden", "authentication failed", "denied")
TAG_FILE_ACCESS = ("open(", "chmod", "chown", "/etc/", "/var/", "/root/")
TAG_RUNTIME = ("exec", "spawn", "shell", "bash", "sh -c", "nc ", "curl ", "wget ")
TAG_CONFIG_RESOURCES = (
    "configmaps", "secrets", "roles", "clusterroles", "rolebindings", "clusterrolebindings",
)
SOURCE_NAMESPACE_KEYS = ("sourceNamespace", "src_namespace", "srcNamespace")

# --- noise and retention ----------------------------------------------------

PROBE_PATHS = ("/healthz", "/readyz", "/livez", "/metrics")
LEASE_VERBS = ("get", "update", "patch")
REVIEW_RESOURCES = ("tokenreviews", "subjectaccessreviews", "selfsubjectrulesreviews")
IGNORED_NAMESPACES = ("kube-system", "kube-public", "kube-node-lease")
FORCED_FIELDS = ("event_id", "timestamp", "source_type", "severity", "event_type", "message")
MAX_SAMPLE_AGE_HOURS = 360

NOISY_CLASSES = (
    "falco_contact_k8s_api_server_from_container",
    "falco_contact_k8_s_api_server_from_container",
)
NOISY_GAP_SECONDS = 30

RECENT_STORE_ROWS = 5000

# --- runtime action labels --------------------------------------------------

ACTION_BY_RULE = {
    "read sensitive file untrusted": "Read sensitive file",
    "write below etc": "Wrote under etc",
    "write below binary dir": "Wrote binary directory",
    "write below root": "Wrote under root",
    "terminal shell in container": "Spawned interactive shell",
    "contact k8s api server from container": "Contacted Kubernetes API",
    "launch package management process in container": "Ran package manager",
    "netcat remote code execution in container": "Netcat remote execution",
    "read ssh information": "Read SSH information",
    "find aws credentials": "Searched cloud credentials",
    "find gcp credentials": "Searched cloud credentials",
    "search private keys or passwords": "Searched private keys",
    "system info discovery": "Collected system information",
    "clear log activities": "Cleared log activities",
    "modify binary dirs": "Modified binary directories",
}
ACTION_BY_HINT = (
    ("sensitive file", "Read sensitive file"),
    ("write below etc", "Wrote under etc"),
    ("write below binary", "Wrote binary directory"),
    ("write below root", "Wrote under root"),
    ("terminal shell", "Spawned interactive shell"),
    ("k8s api server", "Contacted Kubernetes API"),
    ("package management", "Ran package manager"),
    ("netcat", "Netcat remote execution"),
    ("ssh information", "Read SSH information"),
    ("aws credentials", "Searched cloud credentials"),
    ("gcp credentials", "Searched cloud credentials"),
    ("cloud credentials", "Searched cloud credentials"),
    ("private keys", "Searched private keys"),
    ("system info discovery", "Collected system information"),
    ("clear log", "Cleared log activities"),
    ("modify binary", "Modified binary directories"),
)
DEFAULT_ACTION = "Runtime security alert"
ACTION_PRIORITY = {
    "read sensitive file": "Critical",
    "searched cloud credentials": "Critical",
    "read ssh information": "Warning",
    "wrote under etc": "Warning",
    "wrote binary directory": "Warning",
    "ran package manager": "Warning",
    "spawned interactive shell": "Notice",
    "collected system information": "Notice",
    "container exec": "Notice",
    "runtime security alert": "Notice",
}
SHADOW_FILES = ("/etc/shadow", "/etc/sudoers", "/etc/passwd")
CREDENTIAL_PATHS = (
    "/root/.aws/credentials", ".aws/credentials", "google_compute_engine",
    ".config/gcloud", "application_default_credentials", "/root/.gcp",
)
SSH_PATHS = (".ssh", "/etc/ssh")
ETC_WRITE_SIGNS = ("/etc/hacked", "/etc/malicious", "touch /etc", "mkdir /etc")
ETC_WRITE_COMMANDS = ("touch", "mkdir", "write", "open")
BINARY_DIRS = ("/bin/", "/usr/local/bin", "/sbin/")
BINARY_WRITE_SIGNS = ("/bin/nc", "touch /bin")
BINARY_WRITE_COMMANDS = ("touch", "write", "open", "cp", "mv")
PACKAGE_COMMANDS = ("apk add", "apt-get install", "apt install", "yum install", "dnf install")
SHELLS = ("sh", "bash", "zsh", "dash", "ksh", "csh")

# --- features ---------------------------------------------------------------

HASH_BUCKETS = {
    "user": 10_000,
    "source_ip": 10_000,
    "namespace": 5_000,
    "object_type": 2_000,
    "method": 100,
    "event_type": 500,
}
SENSITIVE_WORDS = ("secret", "configmap", "clusterrole", "rolebinding", "pods/exec", "exec")
HIGH_RISK_METHODS = ("create", "delete", "patch", "update")
RBAC_WORDS = ("role", "rolebinding", "clusterrole", "clusterrolebinding", "serviceaccount")

FEATURE_COLS = (
    "feat_user_hash",
    "feat_ip_hash",
    "feat_namespace_hash",
    "feat_object_type_hash",
    "feat_method_hash",
    "feat_event_type_hash",
    "feat_hour",
    "feat_day_of_week",
    "feat_is_off_hours",
    "feat_is_sensitive",
    "feat_is_failed",
    "feat_is_high_risk_method",
    "feat_sensitive_offhour",
    "feat_hist_req_24h",
    "feat_hist_req_7d",
    "feat_hist_req_30d",
    "feat_hist_fail_ratio_7d",
    "feat_hist_unique_namespaces",
    "feat_hist_unique_resources",
    "feat_hist_unique_ips",
    "feat_hist_sensitive_rate_7d",
    "feat_hist_user_hour_baseline",
    "feat_is_new_user",
    "feat_hist_ip_req_24h",
    "feat_hist_ip_fail_ratio_24h",
    "feat_hist_ip_unique_users",
    "feat_is_new_ip",
    "feat_fail_burst_5min",
    "feat_is_rbac_resource",
)

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

# --- scoring, drift, alerts -------------------------------------------------

FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_WEIGHT = 0.6
SEQUENCE_WEIGHT = 0.4
SEQUENCE_LENGTH = 20
TRAIN_SHARE = 0.85
MIN_TRAIN_ROWS = 50
MIN_RETRAIN_ROWS = 200
RETRAIN_DAYS = 30
HOLDOUT_DAYS = 2
PSI_BINS = 10
PSI_FLOOR = 1e-4
PSI_DRIFT = 0.2
PSI_WATCH = 0.1
RATE_BLOWUP = 3.0

LIVE_RISK = (0.9, 0.6)      # HIGH above the first, MEDIUM above the second
TRAINING_RISK = (0.8, 0.5)

ALERT_MIN_SCORE = 0.95
ALERT_METHODS = ("delete", "patch", "exec", "create")
ALERT_RESOURCES = (
    "secrets", "secret", "clusterrolebindings", "clusterrolebinding",
    "rolebindings", "rolebinding", "pods/exec", "runtime_event",
)
ALERT_RUNTIME_WORDS = (
    "shell", "terminal", "passwd", "shadow", "sensitive", "privilege",
    "write below", "unexpected",
)
AUTOMATION_MARKERS = (
    "serviceaccount", "system:", "bot", "ci", "pipeline",
    "argo", "flux", "jenkins", "github-actions", "automation",
)
HUMAN_WORKLOADS = (
    "deployments", "replicasets", "statefulsets", "daemonsets", "pods", "jobs", "cronjobs",
)
