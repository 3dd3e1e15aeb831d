"""Plain pair-by-pair model of the linking rules, for checking small fixtures."""

import hashlib

from sleuthframe.vocabulary import RELATED_CATEGORIES, SEVERITY_RANK

RELATED = {frozenset(p) for p in RELATED_CATEGORIES}


def cat_of(row):
    kind = row["event_type"].upper()
    for name, source, prefix in (("usb", "USB", "USB_"), ("file", "FileSystem", "FILE_")):
        if row["source"] == source or kind.startswith(prefix):
            return name
    if row["source"] == "Browser" or kind == "BROWSER_VISIT":
        return "browser"
    return {"Defender": "defender", "Windows": "windows"}.get(row["source"], "other")


def norm(path):
    return path.replace("\\", "/").rstrip("/").lower()


def evidence(a, b):
    """(signal, reason) pairs for an earlier and a later row inside the window."""
    if a["device"] and b["device"] and a["device"] != b["device"]:
        return []
    found = []
    if a["device"] and a["device"] == b["device"]:
        found.append(("device", f"same device: {a['device']}"))
    if a["user"] and a["user"] == b["user"]:
        found.append(("user", f"same user: {a['user']}"))
    if a["file_path"] and b["file_path"]:
        pa, pb = norm(a["file_path"]), norm(b["file_path"])
        da, db = (p.rpartition("/")[0] for p in (pa, pb))
        if pa == pb:
            found.append(("file", f"same file path: {a['file_path']}"))
        elif da and da == db:
            found.append(("file", f"related file path (same directory): {da}"))
    ca, cb = sorted((cat_of(a), cat_of(b)))
    if frozenset((ca, cb)) in RELATED:
        said = f"related {ca} events" if ca == cb else f"known event-type relationship ({ca} + {cb})"
        found.append(("type_relationship", said))
    return found


def incidents(rows, window=300, smallest=2):
    """{incident id: (sorted ids, reasons, signals, priority)}"""
    rows = sorted((r for r in rows if r["ts"] and r["source"] and r["event_type"]), key=lambda r: (r["ts"], r["id"]))
    comp = {r["id"]: {r["id"]} for r in rows}
    links = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if (b["ts"] - a["ts"]).total_seconds() > window:
                break
            found = evidence(a, b)
            if found:
                links.append((a["id"], found))
                if comp[a["id"]] is not comp[b["id"]]:
                    merged = comp[a["id"]] | comp[b["id"]]
                    for k in merged:
                        comp[k] = merged
    by_id = {r["id"]: r for r in rows}
    out = {}
    for group in {id(g): g for g in comp.values()}.values():
        if len(group) < smallest:
            continue
        digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in group]
        lanes = [sum(int(x[15 * i : 15 * i + 15], 16) for x in digests) for i in range(4)]
        key = "INC-" + hashlib.sha256(":".join(map(str, [len(group), *lanes])).encode()).hexdigest()[:12]
        reasons, signals = set(), set()
        for anchor, found in links:
            if anchor in group:
                signals |= {s for s, _ in found} | {"temporal"}
                reasons |= {r for _, r in found} | {f"temporal proximity (within {int(window)}s window)"}
        out[key] = (sorted(group), reasons, signals, rate([by_id[k] for k in group]))
    return out


def rate(members):
    cats = {cat_of(m) for m in members}
    rank = lambda m: SEVERITY_RANK.get(m["severity"].upper(), 0)
    if "defender" in cats:
        worst = max(rank(m) for m in members if cat_of(m) == "defender")
        level = "CRITICAL" if "file" in cats and worst >= 2 else "HIGH"
    elif {"usb", "file"} <= cats or any(cat_of(m) == "windows" and rank(m) >= 1 for m in members):
        level = "MEDIUM"
    else:
        level = "LOW"
    if level in ("LOW", "MEDIUM") and max(map(rank, members)) >= 3:
        level = "HIGH"
    return level
