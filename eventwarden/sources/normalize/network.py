"""Network flow and cloud audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden.functions import net
from eventwarden.sources.normalize.common import first, normalized, parse, present, stamp, whole

# ---- network flow ---------------------------------------------------------------------------------
FLOW_SCHEMA = ", ".join(f"`{c}` string" for c in (
    "src_ip source_ip source.ip dst_ip destination_ip destination.ip start_time @timestamp timestamp dst_port destination_port destination.port "
    "action bytes_in source.bytes packets duration_ms direction host hostname host_id user user_id proto protocol network.transport bytes_out "
    "destination.bytes bytes process process.name").split())
# Remote-administration ports and other named ports.
ADMIN_PORTS = {
    22: "ssh", 23: "telnet", 445: "smb", 135: "rpc", 139: "netbios", 3389: "rdp", 5985: "winrm_http", 5986: "winrm_https", 5900: "vnc",
}
NAMED_PORTS = {80: "http", 443: "https", 8080: "http_alt", 8443: "https_alt", 53: "dns"}


def _named(table: dict[int, str], port: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), port)


def network_flow(raw: DataFrame) -> DataFrame:
    """Flows with port names and the two shapes worth a look: internal remote administration, outbound."""
    df = parse(raw, FLOW_SCHEMA).withColumns({
        "src": first("src_ip", "source_ip", "source.ip"), "dst": first("dst_ip", "destination_ip", "destination.ip"),
        "port": first("dst_port", "destination_port", "destination.port").try_cast("int"),
        "act": F.lower(F.coalesce(first("action"), F.lit("allow"))),
    })
    kind = {c: net.classify(F.col(c)) for c in ("src", "dst")}
    df = df.withColumns({f"{c}_kind": k for c, k in kind.items()})
    private = {c: F.when(F.col(f"{c}_kind") != "unknown", F.col(f"{c}_kind") == "internal") for c in ("src", "dst")}
    admin = _named(ADMIN_PORTS, F.col("port"))
    lateral = F.coalesce(private["src"] & private["dst"] & admin.isNotNull(), F.lit(False))
    outbound = F.coalesce(private["src"] & ~private["dst"], F.lit(False))
    values = {
        "event_type": F.lit("network"), "host": first("host", "hostname", "host_id"), "user": first("user", "user_id"), "source_ip": F.col("src"),
        "destination_ip": F.col("dst"), "destination_port": F.col("port"), "protocol": first("proto", "protocol", "network.transport"),
        "bytes_out": whole(first("bytes_out", "destination.bytes", "bytes")), "process": first("process", "process.name"), "action": F.col("act"),
        "status": F.when(F.col("act").isin("allow", "accept", "established"), "success").otherwise("failure"),
    }
    metadata = {
        "bytes_in": whole(first("bytes_in", "source.bytes")), "packets": whole(F.col("r.packets")), "duration_ms": whole(F.col("r.duration_ms")),
        "direction": F.col("r.direction"), "source_is_private": private["src"], "destination_is_private": private["dst"],
        "service": F.coalesce(admin, _named(NAMED_PORTS, F.col("port"))), "remote_admin_protocol": F.when(admin.isNotNull(), True),
        "internal_lateral_candidate": F.when(lateral, True), "outbound_external": F.when(outbound, True),
    }
    time = stamp(*[F.col(f"r.`{c}`") for c in ("start_time", "@timestamp", "timestamp")])
    missing = F.col("src").isNull() & F.col("dst").isNull()
    return normalized(df, values, metadata, time, F.when(missing, "network_flow record has no source or destination IP"))


# ---- cloud audit ----------------------------------------------------------------------------------
CLOUD_SCHEMA = (
    "eventName string, event_name string, operation string, methodName string, eventTime string, event_time string, `@timestamp` string, "
    "timestamp string, userIdentity struct<type:string, userName:string, principalId:string, arn:string, accountId:string, "
    "sessionContext:struct<attributes:struct<mfaAuthenticated:string>>>, user string, user_id string, principal string, "
    "recipientAccountId string, account_id string, cloud_account string, eventSource string, service string, errorCode string, error_code string, "
    "requestParameters struct<policyArn:string, policyName:string, userName:string, roleName:string, groupName:string, bucketName:string>, "
    "userAgent string, readOnly boolean, cloudProvider string, awsRegion string, region string, errorMessage string, resource string, "
    "sourceIPAddress string, source_ip string"
)
# Call -> category, risk; inventory calls; policies granting almost everything.
SENSITIVE_CALLS = {
    "AttachUserPolicy": ("privilege_grant", "critical"), "AttachRolePolicy": ("privilege_grant", "critical"),
    "AttachGroupPolicy": ("privilege_grant", "critical"), "PutUserPolicy": ("privilege_grant", "critical"),
    "PutRolePolicy": ("privilege_grant", "critical"), "CreateAccessKey": ("credential_creation", "high"),
    "UpdateAccessKey": ("credential_modification", "high"), "CreateLoginProfile": ("credential_creation", "high"),
    "UpdateLoginProfile": ("credential_modification", "high"), "CreateUser": ("identity_creation", "high"),
    "CreateRole": ("identity_creation", "medium"), "UpdateAssumeRolePolicy": ("trust_policy_change", "critical"),
    "AddUserToGroup": ("privilege_grant", "high"), "DeleteUserPolicy": ("privilege_change", "medium"),
    "PutBucketPolicy": ("resource_exposure", "high"), "PutBucketAcl": ("resource_exposure", "high"),
    "DeleteBucketPolicy": ("resource_exposure", "high"), "ModifyDBInstance": ("resource_exposure", "medium"),
    "AuthorizeSecurityGroupIngress": ("network_exposure", "high"), "StopLogging": ("defense_evasion", "critical"),
    "DeleteTrail": ("defense_evasion", "critical"), "UpdateTrail": ("defense_evasion", "high"), "DeleteFlowLogs": ("defense_evasion", "high"),
    "PutEventSelectors": ("defense_evasion", "high"), "DisableKey": ("defense_evasion", "high"), "ConsoleLogin": ("authentication", "low"),
    "AssumeRole": ("authentication", "low"), "GetSessionToken": ("authentication", "low"),
}
DISCOVERY_CALLS = [
    "ListUsers", "ListRoles", "ListPolicies", "ListGroups", "ListAccessKeys", "GetAccountAuthorizationDetails", "ListAttachedUserPolicies",
    "ListAttachedRolePolicies", "ListBuckets", "DescribeInstances", "ListSecrets", "GetCallerIdentity", "DescribeSecurityGroups",
    "ListGroupsForUser", "GetAccountSummary",
]
HIGH_RISK_POLICIES = [
    "arn:aws:iam::aws:policy/AdministratorAccess", "arn:aws:iam::aws:policy/PowerUserAccess", "arn:aws:iam::aws:policy/IAMFullAccess",
    "AdministratorAccess", "PowerUserAccess", "IAMFullAccess",
]


def cloud_audit(raw: DataFrame) -> DataFrame:
    """Control-plane calls with their category, risk and second-factor state."""
    df = parse(raw, CLOUD_SCHEMA).withColumn("api", first("eventName", "event_name", "operation", "methodName"))
    pairs = [x for k, (category, risk) in SENSITIVE_CALLS.items() for x in (F.lit(k), F.struct(F.lit(category), F.lit(risk)))]
    df = df.withColumn("iam", F.element_at(F.create_map(*pairs), F.col("api")))
    api, category = F.col("api"), F.col("iam.col1")
    inventory = F.coalesce(api.isin(DISCOVERY_CALLS), F.lit(False))
    who = F.col("r.userIdentity")
    named = F.coalesce(present(who["userName"]), present(who["principalId"]), present(who["arn"]), first("user", "user_id", "principal"))
    principal = F.when(named.startswith("arn:"), F.element_at(F.split(named, "/"), -1)).otherwise(named)
    asked = F.col("r.requestParameters")
    policy = F.coalesce(present(asked["policyArn"]), present(asked["policyName"]))
    target = F.coalesce(present(asked["userName"]), present(asked["roleName"]))
    error = first("errorCode", "error_code")
    address = first("sourceIPAddress", "source_ip")
    event_type = (
        F.when(category.isin("privilege_grant", "credential_creation", "credential_modification", "trust_policy_change"), "privilege")
        .when(inventory, "discovery").when(category == "authentication", "authentication").otherwise("cloud_audit"))
    values = {
        "event_type": event_type, "user": principal,
        "source_ip": F.when(~(address.endswith(".amazonaws.com") | (address == "AWS Internal")), address),
        "cloud_provider": F.coalesce(present(F.col("r.cloudProvider")), F.lit("aws")),
        "cloud_account": F.coalesce(present(who["accountId"]), first("recipientAccountId", "account_id", "cloud_account")),
        "cloud_service": present(F.get(F.split(first("eventSource", "service"), r"\."), F.lit(0))),
        "cloud_resource": F.coalesce(present(asked["policyArn"]), present(asked["bucketName"]), present(asked["roleName"]),
                                     present(asked["userName"]), present(F.col("r.resource"))),
        "cloud_region": first("awsRegion", "region"), "action": api, "status": F.when(error.isNotNull(), "failure").otherwise("success"),
        "message": F.col("r.errorMessage"),
    }
    metadata = {
        "api_call": api, "identity_type": present(who["type"]),
        "mfa_authenticated": F.lower(who["sessionContext"]["attributes"]["mfaAuthenticated"]) == "true",
        "user_agent": F.col("r.userAgent"), "read_only": F.coalesce("r.readOnly", F.lit(False)) | inventory,
        "iam_category": category, "iam_risk": F.col("iam.col2"), "cloud_discovery": F.when(inventory, True), "policy": policy,
        "high_risk_policy": policy.isin(HIGH_RISK_POLICIES) | policy.contains("Administrator"), "target_principal": target,
        "target_group": present(asked["groupName"]), "error_code": error,
    }
    time = stamp(*[F.col(f"r.`{c}`") for c in ("eventTime", "event_time", "@timestamp", "timestamp")])
    return normalized(df, values, metadata, time, F.when(api.isNull(), "cloud_audit record has no eventName"))
