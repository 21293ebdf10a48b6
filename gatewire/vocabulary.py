"""Wire names, lookup rows and formats that stored events depend on.

Everything in this module is a fixed value: producers and stored rows already
use these spellings and numbers, so none of them may be tidied up.  Note that
the names producers send (``WIRE_*``) and the names stored ids stand for
(``*_ROWS``) are two separate vocabularies and disagree in places, for example
for the authentication methods 16 to 18 and the spelling of level 0.
"""

# --- fixed values: names accepted in messages -> number -----------------------

WIRE_EVENT_TYPE = {
    "Authenticate": 1,
    "Refresh": 2,
    "TokenExchange": 3,
    "Logout": 4,
}

WIRE_AUTHENTICATION_METHOD = {
    "NotDefined": -1,
    "AltinnPIN": 0,
    "BankID": 1,
    "BuyPass": 2,
    "SAML2": 3,
    "SMSPIN": 4,
    "StaticPassword": 5,
    "TaxPIN": 6,
    "FederationNotUsedAnymore": 7,
    "SelfIdentified": 8,
    "EnterpriseIdentified": 9,
    "Commfides": 10,
    "MinIDPin": 11,
    "OpenSshIdentified": 12,
    "EIDAS": 13,
    "BankIDMobil": 14,
    "MinIDOTC": 15,
    "MaskinPorten": 16,
    "VirksomhetsBruker": 17,
    "TestID": 18,
}

WIRE_SECURITY_LEVEL = {
    "SelfIdentifed": 0,
    "NotSensitive": 1,
    "QuiteSensitive": 2,
    "Sensitive": 3,
    "VerySensitive": 4,
}

WIRE_DECISION = {
    "Permit": 0,
    "Deny": 1,
    "Indeterminate": 2,
    "NotApplicable": 3,
}

# --- fixed values: lookup rows (id, name, description) ------------------------

EVENT_TYPE_ROWS = [
    (1, "Authenticate", "Authenticate"),
    (2, "Refresh", "Refresh"),
    (3, "TokenExchange", "TokenExchange"),
    (4, "Logout", "Logout"),
]

AUTHENTICATION_METHOD_ROWS = [
    (-1, "NotDefined", "NotDefined"),
    (0, "AltinnPIN", "AltinnPIN"),
    (1, "BankID", "BankID"),
    (2, "BuyPass", "BuyPass"),
    (3, "SAML2", "SAML2"),
    (4, "SMSPIN", "SMSPIN"),
    (5, "StaticPassword", "StaticPassword"),
    (6, "TaxPIN", "TaxPIN"),
    (7, "FederationNotUsedAnymore", "FederationNotUsedAnymore"),
    (8, "SelfIdentified", "SelfIdentified"),
    (9, "EnterpriseIdentified", "EnterpriseIdentified"),
    (10, "Commfides", "Commfides"),
    (11, "MinIDPin", "MinIDPin"),
    (12, "OpenSshIdentified", "OpenSshIdentified"),
    (13, "EIDAS", "EIDAS"),
    (14, "BankIDMobil", "BankIDMobil"),
    (15, "MinIDOTC", "MinIDOTC"),
    (16, "EnterpriseMaskinportenIdentified", "EnterpriseMaskinportenIdentified"),
    (17, "IdportenTestId", "IdportenTestId"),
    (18, "MinIDApp", "MinIDApp"),
    (19, "VirksomhetsBruker", "VirksomhetsBruker"),
    (20, "MaskinPorten", "MaskinPorten"),
]

# Rows that joined the method lookup after its first release.
AUTHENTICATION_METHOD_LATER_ROWS = [
    (21, "MinIDTOTP", "MinIDTOTP"),
    (22, "IdportenEpost", "IdportenEpost"),
]

SECURITY_LEVEL_ROWS = [
    (0, "SelfIdentified", "SelfIdentified"),
    (1, "NotSensitive", "NotSensitive"),
    (2, "QuiteSensitive", "QuiteSensitive"),
    (3, "Sensitive", "Sensitive"),
    (4, "VerySensitive", "VerySensitive"),
]

DECISION_ROWS = [
    (1, "Permit", "the requested access is permitted"),
    (2, "Deny", "the requested access is denied"),
    (
        3,
        "Indeterminate",
        "the PDP is unable to evaluate the requested access.  Reasons for such inability include:"
        " missing attributes, network errors while retrieving policies, division by zero during"
        " policy evaluation, syntax errors in the decision request or in the policy, etc.",
    ),
    (4, "NotApplicable", "the PDP does not have any policy that applies to this decision request."),
]

# --- fixed values: partition naming and limits --------------------------------

AUTHN_SCHEMA = "authentication"
AUTHZ_SCHEMA = "authz"
SCHEMA_NAMES = {"authn": AUTHN_SCHEMA, "authz": AUTHZ_SCHEMA}
PARTITION_NAME_PATTERN = "'eventlogv1_y'yyyy'm'MM"
DROP_LOOK_BACK_MONTHS = 24
SUBJECT_PARTY_UUID_MAX_CHARS = 255
SHORTEST_MESSAGE_BYTES = 2
BROTLI_MESSAGE_VERSION = 1
