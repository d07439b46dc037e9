"""Steps that carry boxes over frames: retention, labels of the custom model, gate tracks, shown identities.

A box is a dict with class, confidence and bbox [x1, y1, x2, y2]; the other fields are named where they are used and may
be missing. State is plain dicts in the order in which things came in; of equally good partners the first one is taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from tessera.config import DEFAULT, Thresholds
from tessera.streaming.folds import Step
from tessera.streaming.frames import VEHICLES, overlaps

Box = list[int]


def closeness(a: Box, b: Box) -> tuple[float, float]:
    """Overlap (over the union or the smaller box, whichever is more) and distance of centers in mean sides of the larger box."""
    side = max(1.0, *(((x[2] - x[0]) + (x[3] - x[1])) / 2 for x in (a, b)))
    return max(overlaps(a, b)), math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) / side


def affinity(overlap: float, distance: float) -> float:
    return overlap + 0.25 * max(0.0, 1.0 - distance)


def family(box: dict) -> str:
    name = (box.get("class") or "").lower()
    return "vehicle" if name in VEHICLES else name


def is_custom(box: dict) -> bool:
    return bool(box.get("version")) or box.get("source") == "custom"


LABEL_FIELDS = ("class", "label", "raw_class", "version", "confirmed")
KEPT = "position int, track_id int, class string, label string, raw_class string, source string, version string, confirmed boolean, confidence double, bbox array<int>, retained boolean"


def _told(boxes: list[dict]) -> list[dict]:
    names = [c.split()[0] for c in KEPT.split(", ")]
    return [{**{n: b.get(n) for n in names}, "position": k, "confirmed": bool(b.get("confirmed")), "retained": bool(b.get("retained"))} for k, b in enumerate(boxes)]


@dataclass
class Retention(Step):
    """Boxes that a frame misses stay for a while, and boxes without a track take up one that was there.

    A record {box, frame, at} is kept for each track. A live box without a track takes the free record that fits best (by
    overlap, or by distance within a family); a custom box that fits none gets a new negative track. A live box with a track
    takes the label of a confirmed custom record that fits it, whose own record then goes. A record that no live box took
    is told again with fading confidence, unless a box told before covers it, until retention_seconds (or, if that is 0,
    retention_frames) are over.
    """

    limits: Thresholds = DEFAULT
    number: int = 0
    made: int = 0
    records: dict[str, dict] = field(default_factory=dict)

    def _fitting(self, box: dict, at: float, taken: set[str], custom: bool) -> str | None:
        frames, seconds = self.limits.retention_frames, self.limits.retention_seconds
        best, most = None, 0.0
        for key, r in self.records.items():
            old = r["box"]
            recent = self.number - r["frame"] <= max(2 * frames, frames + 4) or seconds > 0 and at - r["at"] <= max(1.5 * seconds, 0.1)
            if key in taken or not recent or custom and not is_custom(old):
                continue
            overlap, distance = closeness(box["bbox"], old["bbox"])
            if overlap < self.limits.retention_match_overlap and (family(box) != family(old) or distance > self.limits.retention_match_distance):
                continue
            if affinity(overlap, distance) > most:
                best, most = key, affinity(overlap, distance)
        return best

    def _relabel(self, box: dict, old: dict) -> None:
        if is_custom(old) and old.get("confirmed") and not is_custom(box):
            box.update({k: old.get(k) for k in LABEL_FIELDS}, source=old.get("source"))

    def _smooth(self, box: dict, old: dict) -> None:
        a = self.limits.box_alpha
        if a > 0 and closeness(box["bbox"], old["bbox"])[0] >= self.limits.box_alpha_overlap:
            x1, y1, x2, y2 = (round(a * new + (1 - a) * was) for new, was in zip(box["bbox"], old["bbox"]))
            x1, y1 = max(0, x1), max(0, y1)
            box["bbox"] = [x1, y1, max(x1 + 1, x2), max(y1 + 1, y2)]

    def _key(self, box: dict, at: float, taken: set[str], gone: set[str]) -> str | None:
        """The record that a live box belongs to; the box takes track and label from what it fits."""
        tracked = box.get("track_id") is not None
        fits = self._fitting(box, at, taken, custom=tracked)
        if fits:
            old = self.records[fits]["box"]
            self._relabel(box, old)
            if not tracked:
                box["track_id"] = old.get("track_id")
                return fits
        if tracked:
            own = f"track {box['track_id']}"
            if fits and fits != own:
                taken.add(fits)
                gone.add(fits)
            return own
        if is_custom(box):
            self.made += 1
            box["track_id"] = -self.made
            return f"made {self.made}"
        return None

    def frame(self, at: float, boxes: list[dict]) -> list[dict]:
        frames, seconds = self.limits.retention_frames, self.limits.retention_seconds
        self.number += 1
        out, taken, gone = [], set(), set()
        for live in boxes:
            box = {**live, "retained": False}
            key = self._key(box, at, taken, gone)
            if key:
                if key in self.records:
                    self._smooth(box, self.records[key]["box"])
                taken.add(key)
                self.records[key] = {"box": dict(box), "frame": self.number, "at": at}
            out.append(box)
        self.records = {k: r for k, r in self.records.items() if k not in gone}
        for key, r in list(self.records.items()):
            if key in taken:
                continue
            missed, age = self.number - r["frame"], at - r["at"]
            if age > seconds if seconds > 0 else missed > frames:
                del self.records[key]
            elif not any(max(overlaps(r["box"]["bbox"], b["bbox"])) >= self.limits.retention_overlap for b in out):
                progress = max(missed / (frames + 1) if frames > 0 else 0.0, age / max(0.1, seconds) if seconds > 0 else 0.0)
                out.append({**r["box"], "retained": True, "confidence": round(r["box"]["confidence"] * max(0.5, 1 - 0.5 * progress), 3)})
        return _told(out)


@dataclass
class CustomLabels(Step):
    """Labels of the custom model on tracks of the base model, once there is evidence for them.

    Candidates are the boxes of source `custom` without a track; `shape_ok` tells whether their shape can be what they are
    called. A candidate belongs to the base vehicle that it overlaps most. Its evidence counts hits, those of one frame
    once; it starts anew when both the frames and the seconds since the last hit are over. With enough hits and
    confidence, or with confidence alone, the candidate's label goes to the vehicle, or the candidate stays as a box of its
    own. A labelled track keeps the label, as long as it goes on close by and no sure truck is seen where the candidate
    has not been seen for three intervals.
    """

    limits: Thresholds = DEFAULT
    number: int = 0
    made: int = 0
    evidence: dict[str, dict] = field(default_factory=dict)
    labelled: dict[str, dict] = field(default_factory=dict)

    def _recent(self, r: dict, at: float) -> bool:
        return self.number - r["frame"] <= self.limits.custom_confirm_frames or 0 < self.limits.custom_confirm_seconds >= at - r["at"]

    def _place(self, box: dict, target: dict | None, at: float) -> str:
        """The evidence that a candidate adds to: that of its target's track, or of the same class close by."""
        name = (box.get("class") or "").lower()
        if target is not None and target.get("track_id") is not None:
            return f"track {target['track_id']} {name}"
        best, most = None, 0.0
        for key, r in self.evidence.items():
            if r["class"] != name or not self._recent(r, at):
                continue
            overlap, distance = closeness(box["bbox"], r["bbox"])
            if (overlap >= self.limits.custom_match_overlap or distance <= self.limits.custom_near) and affinity(overlap, distance) > most:
                best, most = key, affinity(overlap, distance)
        if best is None:
            self.made += 1
            best = f"made {self.made} {name}"
        return best

    def _at_once(self, box: dict, target: dict | None) -> bool:
        stacker = (box.get("class") or "").lower() == "reach stacker"
        if target is None:
            return box["confidence"] >= self.limits.custom_alone_confidence
        if stacker and _plain_truck(target):
            return box["confidence"] >= self.limits.custom_truck_confidence
        return box["confidence"] >= self.limits.custom_instant_confidence

    def _confirmed(self, box: dict, target: dict | None, at: float) -> bool:
        if not box.get("shape_ok", True):
            return False
        if target is not None and (box.get("class") or "").lower() == "reach stacker" and (target.get("class") or "").lower() == "truck":
            x1, y1, x2, y2 = target["bbox"]
            if max(1, x2 - x1) / max(1, y2 - y1) < 0.75 or target.get("area", 0.0) > 0.09 or target["confidence"] >= 0.85 and box["confidence"] < 0.25:
                return False
        key = self._place(box, target, at)
        old = self.evidence.get(key)
        if old is None or not self._recent(old, at):
            old = {"hits": 0, "most": 0.0, "sure": False, "frame": -1, "at": at}
        hits, most = old["hits"] + (old["frame"] != self.number), max(old["most"], box["confidence"])
        enough = hits >= self.limits.custom_confirm_hits and most >= self.limits.custom_promote_confidence
        sure = old["sure"] or enough or self._at_once(box, target)
        self.evidence[key] = {"class": (box.get("class") or "").lower(), "bbox": box["bbox"], "hits": hits, "most": most, "sure": sure, "frame": self.number, "at": at}
        long, late = max(3 * self.limits.custom_confirm_frames, 18), 3 * self.limits.custom_confirm_seconds
        self.evidence = {k: r for k, r in self.evidence.items() if not (self.number - r["frame"] > long and 0 < late < at - r["at"])}
        return sure

    def _keep(self, box: dict) -> None:
        """The label that a base box's track carries, if it still does."""
        key = str(box.get("track_id"))
        old = self.labelled.get(key)
        if old is None:
            return
        a, b = box["bbox"], old["bbox"]
        if math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) > self.limits.custom_reach:
            del self.labelled[key]
        elif _plain_truck(box) and box["confidence"] >= self.limits.custom_revert_confidence and self.number - old["frame"] > 3 * self.limits.custom_interval:
            del self.labelled[key]
        else:
            old["bbox"] = box["bbox"]
            box.update(old["label"], source="custom", confirmed=True)

    def frame(self, at: float, boxes: list[dict]) -> list[dict]:
        self.number += 1
        candidate = [b.get("source") == "custom" and b.get("track_id") is None for b in boxes]
        out = [dict(b) for b, c in zip(boxes, candidate) if not c]
        base = list(out)
        for box in [b for b, c in zip(boxes, candidate) if c] if self.number % self.limits.custom_interval == 0 else []:
            best = max((b for b in out if (b.get("class") or "").lower() in VEHICLES), key=lambda b: max(overlaps(box["bbox"], b["bbox"])), default=None)
            target = best if best is not None and max(overlaps(box["bbox"], best["bbox"])) >= self.limits.custom_match_overlap else None
            if not self._confirmed(box, target, at):
                continue
            if target is None:
                out.append({**box, "confirmed": True})
                continue
            label = {k: box.get(k) for k in ("class", "label", "confidence", "version")}
            target.update(label, bbox=box["bbox"], source="custom", confirmed=True)
            if target.get("track_id") is not None:
                self.labelled[str(target["track_id"])] = {"label": label, "bbox": box["bbox"], "frame": self.number}
        oldest = self.number - max(30, 15 * self.limits.custom_interval)
        self.labelled = {k: r for k, r in self.labelled.items() if r["frame"] >= oldest}
        for box in base:
            if box.get("track_id") is not None:
                self._keep(box)
        return _told(out)


def _plain_truck(box: dict) -> bool:
    return (box.get("class") or "").lower() == "truck" and (box.get("raw_class") or "").lower() not in {"boat", "train"}


GATE = "track string, class string, bbox array<int>, plate_box array<int>, plate string, plate_confidence double, locked boolean, told boolean"


@dataclass
class GateTracks(Step):
    """Vehicles of a gate camera as tracks of the step's own (V001, ...), with their plates.

    A vehicle goes to the track that it fits best by overlap, else by distance, or begins one; a track may take several
    boxes of a frame. Boxes may carry plate_box, plate and plate_confidence. The plate's box is smoothed; without one it moves
    along with the vehicle. The leading plate of a track is told once, and not within the cooldown of the plate. Tracks end
    after track_expiry_seconds without a box, counted at the end of each frame.
    """

    limits: Thresholds = DEFAULT
    made: int = 0
    tracks: dict[str, dict] = field(default_factory=dict)
    told: dict[str, float] = field(default_factory=dict)

    def _score(self, a: Box, b: Box) -> float:
        iou = overlaps(a, b)[0]
        if iou > self.limits.track_iou:
            return iou + 1.0
        far = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
        return max(0.0, 1.0 - far / self.limits.track_distance)

    def _track(self, box: Box) -> str:
        scores = {t: self._score(box, r["bbox"]) for t, r in self.tracks.items()}
        best = max(scores, key=lambda t: scores[t], default=None)
        if best is not None and scores[best] > self.limits.track_least_score:
            return best
        self.made += 1
        name = f"V{self.made:03d}"
        self.tracks[name] = {"bbox": box, "at": 0.0, "plate_box": None, "share": None, "votes": {}, "lead": None, "told": False}
        return name

    def _plate_box(self, r: dict, box: Box, plate: Box | None) -> None:
        x, y, w, h = box[0], box[1], box[2] - box[0], box[3] - box[1]
        if plate is not None:
            share = [(plate[0] - x) / max(1, w), (plate[1] - y) / max(1, h), (plate[2] - x) / max(1, w), (plate[3] - y) / max(1, h)]
            r["share"] = [min(1.0, max(0.0, s)) for s in share]
            a = self.limits.plate_box_alpha
            was = r["plate_box"]
            r["plate_box"] = [int(a * x + (1 - a) * y) for x, y in zip(plate, was)] if was else list(plate)
        elif r["share"] is not None:
            s = r["share"]
            r["plate_box"] = [int(x + s[0] * w), int(y + s[1] * h), int(x + s[2] * w), int(y + s[3] * h)]

    def _vote(self, r: dict, plate: str, confidence: float) -> None:
        if _signs(plate) < 6:
            return
        n, best = r["votes"].get(plate, (0, 0.0))
        r["votes"][plate] = (n + 1, max(best, confidence))
        r["lead"] = max(r["votes"], key=lambda p: (8.0 if 7 <= _signs(p) <= 9 else 4.0) + 2.5 * r["votes"][p][1] + 0.4 * min(5, r["votes"][p][0]))

    def frame(self, at: float, boxes: list[dict]) -> list[dict]:
        out = []
        for b in boxes:
            box = b["bbox"]
            wide, high = box[2] - box[0], box[3] - box[1]
            if b.get("class") not in ("car", "truck", "bus") or wide < self.limits.vehicle_min_width or high < self.limits.vehicle_min_height:
                continue
            name = self._track(box)
            r = self.tracks[name]
            r["bbox"], r["at"] = box, at
            self._plate_box(r, box, b.get("plate_box"))
            if b.get("plate"):
                self._vote(r, b["plate"], b.get("plate_confidence") or 0.0)
            lead, tells = r["lead"], False
            if lead and not r["told"] and at - self.told.get(lead, -math.inf) >= self.limits.plate_cooldown_seconds:
                r["told"] = tells = True
                self.told[lead] = at
            confidence = r["votes"][lead][1] if lead else None
            out.append({"track": name, "class": b["class"], "bbox": box, "plate_box": r["plate_box"], "plate": lead, "plate_confidence": confidence, "locked": lead is not None, "told": tells})
        self.tracks = {t: r for t, r in self.tracks.items() if at - r["at"] <= self.limits.track_expiry_seconds}
        self.told = {p: t for p, t in self.told.items() if at - t < self.limits.plate_cooldown_seconds}
        return out


def _signs(plate: str) -> int:
    return len(plate.translate(str.maketrans("", "", " -.")))


SHOWN = "shown_id int, track_id int, class string, bbox array<double>, zones array<string>, fresh boolean"


@dataclass
class Shown(Step):
    """A shown identity for each tracked box in a zone, which outlives changes of the track's number.

    A track keeps its identity. A new track takes over that of an entry whose own track is not in the frame, seen at most
    shown_grace_seconds ago, of the same class, with a zone in common and close by; each entry once a frame. An entry that a
    frame does not renew stays for that time, unless its track is seen outside all zones.
    """

    limits: Thresholds = DEFAULT
    entries: list[dict] = field(default_factory=list)  # shown_id, track_id, at, box

    def _near(self, a: list[float], b: list[float]) -> bool:
        sides = [(max(1e-4, x[2] - x[0]), max(1e-4, x[3] - x[1])) for x in (a, b)]
        common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = sum(w * h for w, h in sides) - common
        far = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
        return union > 0 and common / union >= self.limits.shown_iou or far <= self.limits.shown_distance

    def frame(self, at: float, boxes: list[dict]) -> list[dict]:
        seen = {b["track_id"] for b in boxes if b.get("track_id") is not None}
        renewed: set[int] = set()
        for box in boxes:
            track, zones = box.get("track_id"), set(box.get("zones") or ())
            if track is None or not zones:
                continue

            def heir(e: dict, box: dict = box, zones: set = zones) -> bool:
                free = e["shown_id"] not in renewed and e["track_id"] not in seen
                return free and at - e["at"] <= self.limits.shown_grace_seconds and e["box"].get("class") == box.get("class") and bool(zones & set(e["box"]["zones"])) and self._near(e["box"]["bbox"], box["bbox"])

            entry = next((e for e in self.entries if e["track_id"] == track), None) or next(filter(heir, self.entries), None)
            if entry is None:
                entry = {"shown_id": track}
                same = [k for k, e in enumerate(self.entries) if e["shown_id"] == track]
                if same:
                    self.entries[same[0]] = entry
                else:
                    self.entries.append(entry)
            entry.update(track_id=track, at=at, box=box)
            renewed.add(entry["shown_id"])
        self.entries = [e for e in self.entries if e["shown_id"] in renewed or e["track_id"] not in seen and at - e["at"] <= self.limits.shown_grace_seconds]
        return [
            {"shown_id": e["shown_id"], "track_id": e["track_id"], "class": e["box"].get("class"), "bbox": e["box"]["bbox"], "zones": sorted(e["box"]["zones"]), "fresh": e["shown_id"] in renewed}
            for e in sorted(self.entries, key=lambda e: e["shown_id"])
        ]
