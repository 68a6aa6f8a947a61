"""The fixed vocabulary of the model: entity and relation types, state keys, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and rules that answers depend on.
ENTITY_TYPES = (
    "host", "process", "network.interface", "network.address", "network.route", "service.listener",
    "k8s.node", "host.service", "cloud.resource", "service.instance", "db", "network.device",
    "network.endpoint", "compute.vm", "container", "pod", "network.segment", "network.neighbor",
)
#: relation type -> (structural, which way a failure travels)
RELATION_TYPES = {
    "runs_on": (True, "to_from"), "has_interface": (True, "from_to"), "bound_to": (True, "to_from"),
    "next_hop_via": (True, "to_from"), "listens_on": (True, "to_from"), "monitors": (True, "none"),
    "has_route": (True, "from_to"), "neighbor_of": (True, "none"), "connected_to": (True, "both"),
    "depends_on": (True, "to_from"), "same_as": (False, "none"), "resolves_to": (False, "none"),
    "aggregated_into": (True, "none"), "attached_to": (True, "to_from"), "has_segment": (True, "from_to"),
    "routes_via": (True, "to_from"), "forwards_to": (True, "both"), "adjacent_to": (True, "both"),
}
STATE_KEYS = ("oper_state", "admin_state", "status", "replication.role", "read_only", "hw.state", "ha.role")
#: A node of these types may only be left by an outgoing edge.
TERMINAL_TYPES = ("network.endpoint",)
#: A node of these types may not be left by the relation type that entered it.
CHANGING_TYPES = ("network.neighbor", "network.interface")
CHANGE_TYPES = (
    "", "entity.created", "entity.attribute_updated", "entity.state_changed", "entity.identity_changed",
    "entity.deleted", "entity.unchanged", "relation.added", "relation.removed", "relation.attribute_changed",
)
CONFIDENCE = 0.9
MAX_PROMISE_NS = 7 * 86_400 * 10**9
GRACE_NS = 15 * 60 * 10**9
FROZEN = {
    "oper_state": ("up", "down", "testing", "unknown", "dormant", "not_present", "lower_layer_down"),
    "admin_state": ("up", "down", "testing"),
    "duplex": ("full", "half", "unknown"),
    "interface.type": ("physical", "virtual", "wireless", "loopback"),
    "host.chassis.type": ("desktop", "laptop", "server", "blade", "vm", "other"),
    "host.virtualization": ("none", "kvm", "vmware", "xen", "hyperv", "virtualbox", "qemu", "lxc", "openvz", "bhyve", "unknown"),
}
#: Vocabularies that may grow: a value outside is told, not refused.
ADVISORY = ("host.virtualization",)


def structural(relation_type: Column) -> Column:
    """Whether a relation type is structural; unregistered types are not."""
    return relation_type.isin(*[t for t, (s, _) in RELATION_TYPES.items() if s])


def impact_flow(relation_type: Column) -> Column:
    """from_to, to_from, both or none; unregistered types flow both ways."""
    out = F
    for kind in ("from_to", "to_from", "none"):
        out = out.when(relation_type.isin(*[t for t, (_, f) in RELATION_TYPES.items() if f == kind]), kind)
    return out.otherwise("both")


def is_entity_change(change_type: Column) -> Column:
    return change_type.startswith("entity.")


def is_relation_change(change_type: Column) -> Column:
    return change_type.startswith("relation.")
