"""Violation sessions of one camera as a step over its frames; plain Python, used by batch and stream alike.

State is (open, pending): lists of sessions by (track, zone). A frame's hits are detections that break a zone's rule.

    pending   from the first hit; gone with the first frame without one
    open      when hits have lasted `minimum_violation_seconds`
    closed    after `outside_frames` frames in which the track is seen without a hit, or `missing_seconds` unseen
    renumbered  a hit of a new track takes over the open session of an unseen one close by (best overlap, the last of equals)
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import asdict, dataclass, field

from tessera.config import DEFAULT, Thresholds

Box = tuple[float, float, float, float]


@dataclass
class Session:
    track_id: int
    zone_id: str
    object_label: str
    entered_at: float
    last_inside: float
    box: Box
    violation_id: str = ""
    outside: int = 0


@dataclass
class Hit:
    track_id: int
    zone_id: str
    object_label: str
    box: Box
    inside: bool = True  # False: only within the buffer around the zone, which sustains but does not begin


@dataclass
class Machine:
    camera_id: str
    open: list[Session] = field(default_factory=list)
    pending: list[Session] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    def take_back(self, action: str, session: "Session", limits: Thresholds = DEFAULT) -> None:
        """A transition that could not be stored: a start is dropped, so that it begins anew with the next hit; an ended session is
        open again, one frame without a hit before its end, so that it ends again with the same times."""
        if action == "STARTED":
            self.open = [s for s in self.open if s.violation_id != session.violation_id]
        elif all((s.track_id, s.zone_id) != (session.track_id, session.zone_id) for s in self.open):
            session.outside = max(0, limits.outside_frames - 1)
            self.open.append(session)

    @classmethod
    def from_dict(cls, d: dict) -> "Machine":
        return cls(d["camera_id"], *([Session(**{**s, "box": tuple(s["box"])}) for s in d[k]] for k in ("open", "pending")))


def box_iou(a: Box, b: Box) -> float:
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = sum((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) - both
    return both / union if union > 0 else 0.0


def box_distance(a: Box, b: Box) -> float:
    return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def session_id(camera: str, zone: str, track: int, entered: float) -> str:
    """The same in batch and stream, and on a retry."""
    return hashlib.sha256(f"{camera}:{zone}:{track}:{round(entered * 1e6)}".encode()).hexdigest()[:32]


def step(m: Machine, now: float, hits: list[Hit], observed: set[int], limits: Thresholds = DEFAULT) -> list[dict]:
    """Move the machine by one frame; the transitions STARTED and ENDED, in order."""
    out: list[dict] = []
    opened = {(s.track_id, s.zone_id): s for s in m.open}
    pending = {(s.track_id, s.zone_id): s for s in m.pending}
    current = {}
    for h in hits:
        if h.inside or (h.track_id, h.zone_id) in opened or (h.track_id, h.zone_id) in pending:
            current[h.track_id, h.zone_id] = h

    def told(action: str, s: Session, **more: object) -> dict:
        return {"action": action, "violation_id": s.violation_id, "camera_id": m.camera_id, "track_id": s.track_id, "zone_id": s.zone_id, "object_label": s.object_label, "entered_at": s.entered_at, **more}

    for key, h in current.items():
        s = opened.get(key)
        if s is None:
            near = [o for o in opened.values() if o.zone_id == h.zone_id and o.track_id != h.track_id and o.track_id not in observed and now - o.last_inside < limits.missing_seconds]
            near = [o for o in near if box_iou(o.box, h.box) >= limits.reid_iou or box_distance(o.box, h.box) <= limits.reid_distance]
            if near:
                best = max(box_iou(o.box, h.box) for o in near)
                s = [o for o in near if box_iou(o.box, h.box) == best][-1]
                del opened[s.track_id, s.zone_id]
                s.track_id = h.track_id
                opened[key] = s
        if s is not None:
            s.last_inside, s.outside, s.box = now, 0, h.box
            continue
        p = pending.setdefault(key, Session(h.track_id, h.zone_id, h.object_label, now, now, h.box))
        p.last_inside, p.box = now, h.box
        if now - p.entered_at >= limits.minimum_violation_seconds:
            p.violation_id = session_id(m.camera_id, p.zone_id, p.track_id, p.entered_at)
            opened[key] = pending.pop(key)
            out.append(told("STARTED", p, status="OPEN", exited_at=None, duration_seconds=None))
    m.pending = [p for key, p in pending.items() if key in current]
    for key, s in list(opened.items()):
        if key in current:
            continue
        if s.track_id in observed:
            s.outside += 1
            ends = s.outside >= limits.outside_frames
        else:
            ends = now - s.last_inside >= limits.missing_seconds
        if ends:
            out.append(told("ENDED", s, status="CLOSED", exited_at=s.last_inside, duration_seconds=max(0, int(s.last_inside - s.entered_at))))
            del opened[key]
    m.open = list(opened.values())
    return out
