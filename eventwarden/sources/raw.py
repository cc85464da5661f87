"""Source-native telemetry: reading it, and building it from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden.model import event_schema

RAW_DDL = "record_id string, source string, record string, ingested_at timestamp"


def read_raw(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Files of one JSON record per line, all from one source; the id hashes the file, the record and its copy number.

    Equal lines of a file are separate records. They are interchangeable, so they are counted (with map-side combine) and
    numbered from 1: ids stay the same when a task or a batch is run again.
    """
    lines = spark.read.text(path).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"))
    copies = lines.groupBy("file", "record").agg(F.count("*").alias("copies")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(
        F.sha2(F.concat_ws("|", "file", "record", F.col("copy").cast("string")), 256).alias("record_id"), F.lit(source).alias("source"), "record",
        F.current_timestamp().alias("ingested_at"))


def read_raw_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Raw records arriving as JSON-lines files in the raw layout."""
    return spark.readStream.schema(RAW_DDL).option("maxFilesPerTrigger", max_files).json(path)


def read_canonical(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored canonical events under the explicit schema."""
    return spark.read.schema(event_schema()).format(fmt).load(path)


# ---- raw records of the test feed -----------------------------------------------------------------
def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in fields.items()]))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(options: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


SAMPLE_PATHS = [
    "/etc/cron.d/sync", "/home/a/.ssh/authorized_keys", "/etc/shadow", "/etc/sudoers.d/ops", "/var/tmp/report.csv",
    "/usr/lib/systemd/system/x.service", "C:\\Windows\\System32\\Tasks\\Upd", "/root/.bashrc",
]


def raw_records(events: DataFrame) -> DataFrame:
    """Raw records of six sources from the canonical test events, with the odd malformed one.

    ``e`` and ``k`` are the numbers behind an event's id and host, so every variant is a plain modulus.
    """
    c = lambda n: F.col(f"`{n}`")
    e = F.expr("cast(substring(event_id, 5) as bigint)")
    df = events.withColumn("e", e).withColumn("k", F.element_at(F.split("source_ip", r"\."), -1).cast("int")).withColumn(
        "who", F.coalesce(c("user"), F.lit("ghost"))).withColumn(
        "at", F.when(F.col("e") % 50 == 0, "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    e, k, who, ip = c("e"), c("k"), c("who"), c("source_ip")
    kind = c("event_type")
    port = _text(40000 + k)

    failed = _pick([0, 1, 2, 3, 4, 5], e % 6)
    failure = (
        F.when(failed == 0, _text("Failed password for ", who, " from ", ip, " port ", port, " ssh2"))
        .when(failed == 1, _text("Failed publickey for invalid user ", who, " from ", ip, " port ", port, " ssh2"))
        .when(failed == 2, _text("error: maximum authentication attempts exceeded for ", who, " from ", ip, " port ", port, " ssh2 [preauth]"))
        .when(failed == 3, _text("Invalid user ", who, " from ", ip))
        .when(failed == 4, _text("Connection closed authenticating user ", who, " ", ip, " port ", port, " [preauth]"))
        .otherwise(_text("pam noise ", who)))
    success = F.when(e % 3 == 0, _text("Accepted password for ", who, " from ", ip, " port ", port, " ssh2")).otherwise(
        _text("pam_unix(x:session): session opened for user ", who, "(uid=1000) by (uid=0)"))
    raised = (
        F.when(e % 4 == 0, _text(who, " : TTY=pts/0 ; PWD=/home/x ; USER=root ; COMMAND=/bin/bash -c id"))
        .when(e % 4 == 1, _text(who, " : user NOT in sudoers ; TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/sh"))
        .when(e % 4 == 2, _text("(to root) ", who, " on pts/1")).otherwise(_text("FAILED SU (to backup) ", who, " on pts/1")))
    account = (
        F.when(e % 3 == 0, _text("new user: name=", who, ", UID=", e % 2, ", GID=100, home=/home/x"))
        .when(e % 3 == 1, F.concat(F.lit("add '"), who, F.lit("' to group '"), F.when(e % 2 == 0, "sudo").otherwise("developers"), F.lit("'")))
        .otherwise(_text("password changed for ", who)))
    is_failure = (kind == "authentication") & (c("status") == "failure")
    linux = df.filter(kind.isin("authentication", "privilege", "account")).select(
        "e", F.lit("linux_auth").alias("source"), "timestamp", _json(
            timestamp=c("at"), host=c("host"), pid=k,
            program=F.when(is_failure, "sshd").when(kind == "authentication", _pick(["sshd", "sshd", "cron"], e % 3))
            .when(kind == "privilege", _pick(["sudo", "sudo", "su", "su"], e % 4)).otherwise("useradd"),
            message=F.when(is_failure, failure).when(kind == "authentication", success).when(kind == "privilege", raised).otherwise(account),
        ).alias("record"))

    event = (
        F.when(e % 41 == 0, "n/a").when(is_failure, "4625").when(kind == "authentication", "4624").when(kind == "privilege", "4672")
        .when(kind == "service", F.when(e % 2 == 0, "7045").otherwise("9999")).otherwise(_pick(["4720", "4728", "4724"], e % 3)))
    grouping = (kind == "account") & (e % 3 == 1)
    windows = df.filter(kind.isin("authentication", "privilege", "account", "service")).select(
        "e", F.lit("windows_security").alias("source"), "timestamp", _json(
            TimeCreated=c("at"), EventID=event, Computer=c("host"),
            TargetUserName=F.when(grouping, F.when(e % 2 == 0, "Administrators").otherwise("Developers")).otherwise(who),
            IpAddress=F.when(e % 7 == 0, "-").otherwise(ip), IpPort=port,
            LogonType=F.when(k % 4 == 0, 3).when(k % 4 == 1, 10).when(k % 4 == 2, 99),
            SubStatus=F.when(is_failure, F.when(e % 2 == 0, "0xC000006A").otherwise("0xC0000099")),
            PrivilegeList=F.when(kind == "privilege", "SeDebugPrivilege\n\tSeChangeNotifyPrivilege"),
            MemberName=F.when(grouping & (e % 5 != 0), _text("CN=", who, ",OU=Users")),
            ProcessId=F.when(kind == "service", F.when(e % 4 == 0, "0x1F4").otherwise("500")), ServiceName=F.when(kind == "service", "svc-x"),
        ).alias("record"))

    name = (
        F.when(e % 3 == 0, "/usr/bin/python3").when(k % 3 == 0, "C:\\Windows\\System32\\NET.EXE").otherwise(_text("/usr/bin/", c("process"))))
    outcome = F.when(k % 9 == 0, "failure").otherwise("Success")
    nested = F.to_json(F.struct(
        c("at").alias("@timestamp"), F.struct(c("host").alias("name")).alias("host"), F.struct(who.alias("name")).alias("user"),
        F.struct(name.alias("name"), k.alias("pid"), c("command_line").alias("command_line"),
                 F.struct(F.lit("bash").alias("name"), F.lit(1).alias("pid")).alias("parent")).alias("process"),
        F.struct(F.lit("exec").alias("action"), outcome.alias("outcome")).alias("event")))
    flat = F.to_json(F.struct(
        c("at").alias("timestamp"), c("host").alias("host.name"), who.alias("user.name"), name.alias("process.name"), k.alias("process.pid"),
        c("command_line").alias("process.command_line"), F.lit("bash").alias("process.parent.name"), outcome.alias("event.outcome")))
    processes = df.filter(kind == "discovery").select(
        "e", F.when(e % 10 == 0, "linux_auditd").otherwise("edr_process").alias("source"), "timestamp",
        F.when(e % 2 == 0, nested).otherwise(flat).alias("record"))

    flows = df.filter(kind == "network").select(
        "e", F.lit("network_flow").alias("source"), "timestamp", _json(
            start_time=c("at"), host=c("host"), user=who,
            src_ip=F.when(e % 47 == 0, None).when(e % 45 == 0, "bogus").otherwise(ip),
            dst_ip=F.when(e % 47 == 0, None).when(k % 5 == 0, _text("203.0.113.", k)).otherwise(c("destination_ip")),
            dst_port=c("destination_port"), proto="tcp", bytes_out=c("bytes_out"), bytes_in=k,
            action=F.when(k % 7 == 0, "deny").otherwise("ALLOW"),
        ).alias("record"))

    files = df.filter(kind == "file").select(
        "e", F.lit("file_integrity").alias("source"), "timestamp", _json(
            time=c("at"), host=c("host"), user=who, path=_pick(SAMPLE_PATHS, e % 8), action="Modify", mode=_pick(["4755", "0644", "755"], k % 3),
            size=k, hash_sha256=c("file_hash"),
        ).alias("record"))

    identity = F.struct(
        F.lit("IAMUser").alias("type"), F.when(e % 4 != 0, who).alias("userName"), _text("arn:aws:iam::1:user/ops/", who).alias("arn"),
        c("cloud_account").alias("accountId"),
        F.when(e % 5 != 0, F.struct(F.struct(F.when(e % 3 == 0, "false").otherwise("true").alias("mfaAuthenticated")).alias("attributes"))).alias("sessionContext"))
    asked = F.struct(
        F.when(c("action") == "AttachUserPolicy", F.when(e % 2 == 0, "arn:aws:iam::aws:policy/AdministratorAccess").otherwise("ReadOnlyAccess")).alias("policyArn"),
        F.when(c("action") == "CreateAccessKey", who).alias("userName"))
    cloud = df.filter(kind == "cloud_audit").select(
        "e", F.lit("cloud_audit").alias("source"), "timestamp", _json(
            eventTime=c("at"), eventSource="iam.amazonaws.com", eventName=c("action"), userIdentity=identity,
            sourceIPAddress=F.when(e % 6 == 0, "iam.amazonaws.com").otherwise(ip), awsRegion=c("cloud_region"), readOnly=e % 2 == 0,
            requestParameters=asked, errorCode=F.when(k % 7 == 0, "AccessDenied"),
        ).alias("record"))

    out = linux
    for part in (windows, processes, flows, files, cloud):
        out = out.unionByName(part)
    return out.select(F.concat_ws(":", "source", "e").alias("record_id"), "source", "record", F.col("timestamp").alias("ingested_at"))
