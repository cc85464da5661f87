"""Host-side sources: Linux auth log, Windows Security, endpoint processes, file integrity."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.sources.normalize.common import first, normalized, parse, present, stamp, whole

# ---- Linux auth log -------------------------------------------------------------------------------
LINUX_SCHEMA = (
    "message string, msg string, line string, host string, hostname string, host_id string, program string, process string, "
    "syslog_program string, timestamp string, `@timestamp` string, time string, pid bigint"
)
# Message shapes, tried in this order, and privileged groups.
_METHODS = "(password|publickey|keyboard-interactive/pam)"
FAILED = rf"Failed {_METHODS} for (?:invalid user )?(\S+) from (\S+) port (\d+)"
ACCEPTED = rf"Accepted {_METHODS} for (\S+) from (\S+) port (\d+)"
MAX_AUTH = r"error: maximum authentication attempts exceeded for (?:invalid user )?(\S+) from (\S+)"
INVALID = r"Invalid user (\S+) from (\S+)"
DISCONNECT = r"(?:Received disconnect|Connection closed) (?:from )?(?:authenticating user (\S+) )?([\d.:a-fA-F]+)"
SUDO_OK = r"^\s*(\S+)\s*:\s*TTY=(\S*)\s*;\s*PWD=(\S*)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.+)$"
SUDO_FAIL = r"^\s*(\S+)\s*:\s*(user NOT in sudoers|\d+ incorrect password attempts?)"
SU = r"\(to (\S+)\) (\S+) on (\S+)"
SESSION = r"session opened for user (\S+?)(?:\(uid=\d+\))? by (?:(\S+?))?\(uid=(\d+)\)"
USERADD = r"(?i)new user: name=([^,]+), UID=(\d+), GID=(\d+)"
GROUP_ADD = r"add '([^']+)' to group '([^']+)'"
PASSWORD = r"password changed for (\S+)"
LINUX_GROUPS = ["sudo", "wheel", "admin", "root", "adm"]
SESSION_PROGRAMS = ["sudo", "su", "sshd", "systemd-logind", "login"]


def linux_auth(raw: DataFrame) -> DataFrame:
    """Auth log lines; a line of no known shape is kept as ``unparsed``."""
    df = parse(raw, LINUX_SCHEMA).withColumn("m", F.coalesce(first("message", "msg", "line"), F.lit(""))).withColumn(
        "program", F.lower(F.coalesce(first("program", "process", "syslog_program"), F.lit(""))))
    m, program = F.col("m"), F.col("program")
    shapes = [
        ("failed", m.rlike(FAILED)), ("accepted", m.rlike(ACCEPTED)), ("max_auth", m.rlike(MAX_AUTH)), ("invalid", m.rlike(INVALID)),
        ("disconnect", m.rlike(DISCONNECT)),
        ("sudo_ok", (program == "sudo") & m.rlike(SUDO_OK)), ("sudo_fail", (program == "sudo") & m.rlike(SUDO_FAIL)),
        ("su", (program == "su") & m.rlike(SU)), ("session", program.isin(SESSION_PROGRAMS) & m.rlike(SESSION)),
        ("useradd", m.rlike(USERADD)), ("group", m.rlike(GROUP_ADD)), ("password", m.rlike(PASSWORD)),
    ]
    shape = reduce(lambda acc, s: acc.when(s[1], s[0]), shapes[1:], F.when(shapes[0][1], shapes[0][0])).otherwise("unparsed")
    df = df.withColumn("shape", shape)
    s = F.col("shape")
    is_ = lambda *names: s.isin(*names)
    # each entry: shape -> (pattern, group number)
    pick = lambda **at: reduce(lambda acc, kv: acc.when(s == kv[0], present(F.regexp_extract(m, kv[1][0], kv[1][1]))), at.items(), F.when(F.lit(False), ""))
    user = pick(failed=(FAILED, 2), accepted=(ACCEPTED, 2), max_auth=(MAX_AUTH, 1), invalid=(INVALID, 1), disconnect=(DISCONNECT, 1),
                sudo_ok=(SUDO_OK, 1), sudo_fail=(SUDO_FAIL, 1), su=(SU, 2), session=(SESSION, 1), useradd=(USERADD, 1),
                group=(GROUP_ADD, 1), password=(PASSWORD, 1))
    target = pick(sudo_ok=(SUDO_OK, 4), su=(SU, 1))
    uid = whole(pick(useradd=(USERADD, 2)))
    group = pick(group=(GROUP_ADD, 2))
    ssh = is_("failed", "accepted", "max_auth", "invalid", "disconnect")
    event_type = (
        F.when(is_("sudo_ok", "sudo_fail", "su"), "privilege").when(is_("useradd", "group", "password"), "account").otherwise("authentication"))
    action = (
        F.when(is_("failed", "accepted", "max_auth", "invalid"), "login").when(s == "disconnect", "disconnect")
        .when(is_("sudo_ok", "sudo_fail"), "sudo").when(s == "su", "su").when(s == "session", "session_open")
        .when(s == "useradd", "account_created").when(s == "group", "group_member_added").when(s == "password", "password_changed")
        .otherwise("unparsed"))
    su_failed = (s == "su") & F.upper(m).contains("FAILED")
    status = (
        F.when(is_("failed", "max_auth", "invalid", "sudo_fail") | su_failed, "failure").when(is_("disconnect", "unparsed"), "unknown")
        .otherwise("success"))
    values = {
        "event_type": event_type, "action": action, "status": status, "host": first("host", "hostname", "host_id"), "user": user,
        "source_ip": pick(failed=(FAILED, 3), accepted=(ACCEPTED, 3), max_auth=(MAX_AUTH, 2), invalid=(INVALID, 2), disconnect=(DISCONNECT, 2)),
        "destination_port": pick(failed=(FAILED, 4), accepted=(ACCEPTED, 4)).try_cast("int"), "process": present(program),
        "process_id": F.col("r.pid"), "command_line": pick(sudo_ok=(SUDO_OK, 5)), "message": m,
    }
    metadata = {
        "auth_method": pick(failed=(FAILED, 1), accepted=(ACCEPTED, 1)),
        "service": F.when(ssh, "ssh").when(s == "session", program),
        "invalid_user": F.when(s == "failed", m.contains("invalid user")).when(s == "invalid", True),
        "reason": F.when(s == "max_auth", "max_auth_attempts").otherwise(pick(sudo_fail=(SUDO_FAIL, 2))),
        "target_user": target, "tty": pick(sudo_ok=(SUDO_OK, 2), su=(SU, 3)), "cwd": pick(sudo_ok=(SUDO_OK, 3)),
        "elevated": F.when(s == "sudo_ok", target.isin("root", "0")).when(s == "su", target == "root"),
        "opened_by_uid": pick(session=(SESSION, 3)), "uid": uid, "gid": whole(pick(useradd=(USERADD, 3))), "uid_zero": uid == 0,
        "group": group, "privileged_group": F.lower(group).isin(LINUX_GROUPS),
        "tool": F.when(is_("useradd", "group", "password"), program),
        "normalizer": F.when(s == "unparsed", "linux_auth"), "parsed": F.when(s == "unparsed", False),
        "program": F.when(s == "unparsed", program),
    }
    return normalized(df, values, metadata, stamp(*[F.col(f"r.`{c}`") for c in ("timestamp", "@timestamp", "time")]))


# ---- Windows Security -----------------------------------------------------------------------------
WINDOWS_SCHEMA = ", ".join(f"`{c}` string" for c in (
    "EventID event_id EventCode TimeCreated @timestamp timestamp EventTime Computer host hostname ComputerName TargetUserName "
    "SubjectUserName user AccountName IpAddress SourceNetworkAddress source_ip LogonType SubStatus Status PrivilegeList GroupName "
    "MemberName MemberSid ServiceName StartType TaskName IpPort NewProcessName ProcessName NewProcessId ProcessId ParentProcessName "
    "CommandLine ObjectName ShareName Message").split())
# Event id -> type, action, status; logon types; failure sub-status codes; privileged groups.
WINDOWS_EVENTS = {
    4624: ("authentication", "login", "success"), 4625: ("authentication", "login", "failure"),
    4634: ("authentication", "logoff", "success"), 4648: ("authentication", "explicit_credential_login", "success"),
    4672: ("privilege", "special_privileges_assigned", "success"), 4673: ("privilege", "privileged_service_called", "success"),
    4688: ("process", "process_created", "success"), 4689: ("process", "process_terminated", "success"),
    4720: ("account", "account_created", "success"), 4722: ("account", "account_enabled", "success"),
    4724: ("account", "password_reset", "success"), 4728: ("account", "group_member_added", "success"),
    4732: ("account", "group_member_added", "success"), 4738: ("account", "account_changed", "success"),
    4776: ("authentication", "credential_validation", "success"), 4798: ("discovery", "local_group_enumerated", "success"),
    4799: ("discovery", "local_group_enumerated", "success"), 5140: ("network", "network_share_accessed", "success"),
    5145: ("network", "network_share_checked", "success"), 7045: ("service", "service_installed", "success"),
    4698: ("scheduled_task", "scheduled_task_created", "success"),
}
LOGON_TYPES = {
    2: "interactive", 3: "network", 4: "batch", 5: "service", 7: "unlock", 8: "network_cleartext", 9: "new_credentials",
    10: "remote_interactive", 11: "cached_interactive",
}
FAILURE_REASONS = {
    "0xc0000064": "user_does_not_exist", "0xc000006a": "bad_password", "0xc0000234": "account_locked_out",
    "0xc0000072": "account_disabled", "0xc0000071": "password_expired", "0xc000006d": "bad_credentials",
    "0xc000006e": "account_restriction",
}
WINDOWS_GROUPS = ["administrators", "domain admins", "enterprise admins", "schema admins", "account operators", "backup operators"]


def _lookup(table: dict, key: Column, kind: str | None = None) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def _hex_or_int(column: Column) -> Column:
    text = F.trim(column)
    digits = F.regexp_extract(text, "^0[xX]([0-9a-fA-F]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).try_cast("bigint")).otherwise(text.try_cast("bigint"))


def windows_security(raw: DataFrame) -> DataFrame:
    """Security channel records; ids outside the table carry no signal and are dropped."""
    df = parse(raw, WINDOWS_SCHEMA).withColumn("id", first("EventID", "event_id", "EventCode").try_cast("bigint"))
    event = F.col("id")
    known = event.isin(list(WINDOWS_EVENTS))
    df = df.filter(event.isNull() | known)
    table = {k: F.struct(*[F.lit(x) for x in v]) for k, v in WINDOWS_EVENTS.items()}
    pairs = [x for k, v in table.items() for x in (F.lit(k).cast("bigint"), v)]
    df = df.withColumn("e", F.element_at(F.create_map(*pairs), event))
    grouping = event.isin(4728, 4732)
    member = first("MemberName", "MemberSid")
    member_name = present(F.regexp_replace(F.get(F.split(member, ","), F.lit(0)), "CN=", ""))
    group = F.when(grouping, F.lower(F.coalesce(first("TargetUserName", "GroupName"), F.lit(""))))
    account = first("TargetUserName", "SubjectUserName", "user", "AccountName")
    address = first("IpAddress", "SourceNetworkAddress", "source_ip")
    logon = present(F.col("r.LogonType")).try_cast("bigint")
    sub = F.lower(F.coalesce(first("SubStatus", "Status"), F.lit("")))
    metadata = {
        "windows_event_id": event, "logon_type": logon,
        "logon_type_name": F.coalesce(_lookup({k: v for k, v in LOGON_TYPES.items()}, logon.cast("int")), logon.cast("string")),
        "failure_reason": F.when(event == 4625, F.coalesce(_lookup(FAILURE_REASONS, sub), present(sub), F.lit("unknown"))),
        "privileges": F.when(event == 4672, F.filter(F.split(F.coalesce("r.PrivilegeList", F.lit("")), r"\s+"), lambda p: p != "")),
        "elevated": F.when(event == 4672, True), "group": group, "privileged_group": group.isin(WINDOWS_GROUPS),
        "member": F.when(grouping, member), "service_name": F.when(event == 7045, F.col("r.ServiceName")),
        "service_start_type": F.when(event == 7045, F.col("r.StartType")), "task_name": F.when(event == 4698, F.col("r.TaskName")),
    }
    values = {
        "event_type": F.coalesce("e.col1", F.lit("authentication")), "action": F.col("e.col2"), "status": F.coalesce("e.col3", F.lit("unknown")),
        "host": first("Computer", "host", "hostname", "ComputerName"),
        "user": F.when(grouping & member.isNotNull(), F.coalesce(member_name, account)).otherwise(account),
        "source_ip": F.when(~address.isin("-", "::1"), address), "destination_port": _hex_or_int(present(F.col("r.IpPort"))).try_cast("int"),
        "process": first("NewProcessName", "ProcessName"), "process_id": _hex_or_int(first("NewProcessId", "ProcessId")),
        "parent_process": F.col("r.ParentProcessName"), "command_line": F.col("r.CommandLine"), "file_path": first("ObjectName", "ShareName"),
        "message": F.col("r.Message"),
    }
    time = stamp(*[F.col(f"r.`{c}`") for c in ("TimeCreated", "@timestamp", "timestamp", "EventTime")])
    return normalized(df, values, metadata, time, F.when(event.isNull(), "windows_security record has no numeric EventID"))


# ---- endpoint processes ---------------------------------------------------------------------------
# nested documents, with the flat dotted keys some exporters use
EDR_SCHEMA = (
    "`@timestamp` string, timestamp string, host struct<name:string>, agent struct<hostname:string>, host_id string, user struct<name:string>, user_id string, "
    "process struct<name:string, executable:string, pid:string, command_line:string, working_directory:string, integrity_level:string, "
    "parent:struct<name:string, pid:string>, hash:struct<sha256:string>>, event struct<action:string, outcome:string, created:string>, message string, "
    "process_name string, command_line string, parent_process string, "
    "`process.name` string, `process.executable` string, `process.pid` string, `process.command_line` string, `process.working_directory` string, "
    "`process.integrity_level` string, `process.parent.name` string, `process.parent.pid` string, `process.hash.sha256` string, `host.name` string, "
    "`agent.hostname` string, `user.name` string, `event.action` string, `event.outcome` string, `event.created` string"
)
# Commands that enumerate, by what they enumerate; interpreters; telling argument tokens.
DISCOVERY_COMMANDS = {
    "whoami": "account", "id": "account", "groups": "account", "getent": "account", "lastlog": "account", "last": "account", "w": "account",
    "net": "account", "net1": "account", "dsquery": "account",
    "uname": "system", "hostnamectl": "system", "lscpu": "system", "systeminfo": "system", "ver": "system", "lsb_release": "system",
    "ifconfig": "network", "ip": "network", "netstat": "network", "ss": "network", "arp": "network", "route": "network", "nmap": "network",
    "ipconfig": "network",
    "sudo": "permission", "visudo": "permission", "find": "permission", "getcap": "permission", "crontab": "permission",
}
INTERPRETERS = [
    "bash", "sh", "zsh", "dash", "ksh", "python", "python3", "perl", "ruby", "powershell", "pwsh", "cmd", "wscript", "cscript", "node",
]
ARGUMENT_TOKENS = [
    ("-perm -4000", "suid_enumeration"), ("-perm -u=s", "suid_enumeration"), ("/etc/shadow", "credential_file_access"),
    ("/etc/sudoers", "sudoers_access"), ("id_rsa", "private_key_access"), (".ssh/authorized_keys", "authorized_keys_access"),
    ("-enc ", "encoded_command"), ("-EncodedCommand", "encoded_command"), ("base64 -d", "encoded_command"), ("curl ", "remote_download"),
    ("wget ", "remote_download"), ("nc -e", "reverse_shell"), ("/dev/tcp/", "reverse_shell"),
]


def _dig(path: str) -> Column:
    """A nested field, or the same path as one flat key when the record has it."""
    nested = F.col("r." + ".".join(f"`{p}`" for p in path.split(".")))
    return F.coalesce(F.col(f"r.`{path}`"), present(nested)) if "." in path else present(nested)


def edr_process(raw: DataFrame) -> DataFrame:
    """Process events in nested or flat form; enumeration commands become discovery events."""
    name = F.coalesce(present(_dig("process.name")), _dig("process_name"))
    df = parse(raw, EDR_SCHEMA).withColumn("name", name).withColumn(
        "cmd", F.coalesce(present(_dig("process.command_line")), _dig("command_line"), F.lit("")))
    tail = F.element_at(F.split(F.element_at(F.split("name", "/"), -1), r"\\"), -1)
    df = df.withColumn("base", F.regexp_replace(F.lower(tail), r"\.exe$", ""))
    base = F.col("base")
    haystack = F.concat("cmd", F.lit(" "), "name")
    labels: dict[str, list[str]] = {}
    for token, label in ARGUMENT_TOKENS:
        labels.setdefault(label, []).append(token)
    found = F.array_compact(F.array(*[
        F.when(reduce(or_, [haystack.contains(t) for t in tokens]), F.lit(label)) for label, tokens in sorted(labels.items())]))
    category = _lookup(DISCOVERY_COMMANDS, base)
    outcome = F.lower(F.coalesce(_dig("event.outcome"), F.lit("success")))
    values = {
        "event_type": F.when(category.isNotNull(), "discovery").otherwise("process"),
        "host": F.coalesce(present(_dig("host.name")), present(_dig("agent.hostname")), _dig("host_id")),
        "user": F.coalesce(present(_dig("user.name")), _dig("user_id")), "process": F.col("name"), "process_id": whole(_dig("process.pid")),
        "parent_process": F.coalesce(present(_dig("process.parent.name")), _dig("parent_process")), "command_line": F.col("cmd"),
        "file_hash": _dig("process.hash.sha256"), "action": F.coalesce(_dig("event.action"), F.lit("process_created")),
        "status": F.when(outcome.isin("success", "allowed"), "success").otherwise("failure"), "message": _dig("message"),
    }
    metadata = {
        "executable": present(_dig("process.executable")), "working_directory": present(_dig("process.working_directory")),
        "parent_pid": whole(_dig("process.parent.pid")), "integrity_level": present(_dig("process.integrity_level")), "base_name": present(base),
        "discovery_category": category, "interpreter": F.when(base.isin(INTERPRETERS), True), "argument_indicators": F.when(F.size(found) > 0, found),
    }
    time = stamp(F.col("r.`@timestamp`"), F.col("r.timestamp"), F.col("r.`event.created`"))
    return normalized(df, values, metadata, time, F.when(F.col("name").isNull(), "edr_process record has no process.name"))


# ---- file integrity -------------------------------------------------------------------------------
FILE_SCHEMA = ", ".join(f"`{c}` string" for c in (
    "path file_path file.path target time @timestamp timestamp action event_type mode owner size previous_hash host hostname host_id user user_id "
    "process process_name hash_sha256 sha256 file.hash.sha256 message").split())
# Path fragments in order and the autostart mechanism each implements; sensitive files.
PERSISTENCE_PATHS = [
    ("/etc/cron.d", "cron"), ("/etc/cron.daily", "cron"), ("/etc/cron.hourly", "cron"), ("/var/spool/cron", "cron"), ("/etc/crontab", "cron"),
    ("/etc/systemd/system", "systemd_service"), ("/lib/systemd/system", "systemd_service"), ("/usr/lib/systemd/system", "systemd_service"),
    ("/etc/init.d", "init_script"), ("/etc/rc.local", "init_script"), ("/etc/profile.d", "shell_profile"), ("/etc/bash.bashrc", "shell_profile"),
    ("/root/.bashrc", "shell_profile"), ("/root/.ssh/authorized_keys", "ssh_authorized_keys"), (".ssh/authorized_keys", "ssh_authorized_keys"),
    ("/etc/ld.so.preload", "library_preload"), ("/etc/passwd", "account_file"), ("/etc/shadow", "credential_file"), ("/etc/sudoers", "sudoers"),
    ("/etc/sudoers.d", "sudoers"), ("C:\\Windows\\System32\\Tasks", "scheduled_task"), ("Start Menu\\Programs\\Startup", "startup_folder"),
]
SENSITIVE_FILES = ["/etc/shadow", "/etc/sudoers", "/etc/passwd"]


def file_integrity(raw: DataFrame) -> DataFrame:
    """File change records; the first matching path fragment names the autostart mechanism."""
    df = parse(raw, FILE_SCHEMA).withColumn("p", first("path", "file_path", "file.path", "target"))
    path = F.col("p")
    mechanism = reduce(
        lambda acc, item: acc.when(path.contains(item[0]), item[1]), PERSISTENCE_PATHS[1:],
        F.when(path.contains(PERSISTENCE_PATHS[0][0]), PERSISTENCE_PATHS[0][1]))
    mode = F.coalesce("r.mode", F.lit(""))
    setuid = (F.length(mode) >= 4) & F.substring(mode, -4, 1).isin("4", "6", "7")
    values = {
        "event_type": F.lit("file"), "host": first("host", "hostname", "host_id"), "user": first("user", "user_id", "owner"),
        "process": first("process", "process_name"), "file_path": path, "file_hash": first("hash_sha256", "sha256", "file.hash.sha256"),
        "action": F.lower(F.coalesce(first("action", "event_type"), F.lit("modify"))), "status": F.lit("success"), "message": F.col("r.message"),
    }
    metadata = {
        "mode": present(F.col("r.mode")), "owner": present(F.col("r.owner")), "size": whole(F.col("r.size")),
        "previous_hash": present(F.col("r.previous_hash")), "persistence_mechanism": mechanism,
        "persistence_path": F.when(mechanism.isNotNull(), True), "sensitive_file": F.when(path.isin(SENSITIVE_FILES), True),
        "setuid": F.when(setuid, True),
    }
    time = stamp(*[F.col(f"r.`{c}`") for c in ("time", "@timestamp", "timestamp")])
    return normalized(df, values, metadata, time, F.when(path.isNull(), "file_integrity record has no path"))
