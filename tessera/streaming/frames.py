"""Steps over the boxes of one frame, and over the frames of one track; plain Python on dicts and lists.

A detection is a dict with class, confidence, bbox [x1, y1, x2, y2] in pixels, and optionally source and trackId.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from tessera.config import DEFAULT, Thresholds

# Classes that count as vehicles, and how specific a class name is.
VEHICLES = {"truck", "car", "bus", "motorcycle", "forklift", "container handler", "reach stacker", "container", "shipping container", "personnel carrier", "utility vehicle", "golf cart"}
SPECIFIC = {"reach stacker": 0.35, "container handler": 0.30, "forklift": 0.25, "truck": 0.12, "bus": 0.08, "car": 0.05, "container": 0.05, "shipping container": 0.05, "personnel carrier": -0.10, "utility vehicle": -0.10, "golf cart": -0.10}
SOURCES = {"custom": 3, "primary": 2, "aux": 1}


def _both(a: list[int], b: list[int]) -> int:
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def _area(a: list[int]) -> int:
    return max(1, (a[2] - a[0]) * (a[3] - a[1]))


def overlaps(a: list[int], b: list[int]) -> tuple[float, float]:
    """Intersection over union, and over the smaller box."""
    both = _both(a, b)
    return both / (_area(a) + _area(b) - both), both / min(_area(a), _area(b))


def suppress(detections: list[dict], limits: Thresholds = DEFAULT) -> list[dict]:
    """Greedy suppression over classes: the better source, then confidence with class specificity, stays. What carries a custom model's version is of the best source."""
    name = lambda d: (d.get("class") or "").lower()
    rank = lambda d: (SOURCES["custom"] if d.get("version") else SOURCES.get(d.get("source"), 0), d["confidence"] + SPECIFIC.get(name(d), 0.0))
    kept: list[dict] = []
    for d in sorted(detections, key=rank, reverse=True):
        for k in kept:
            iou, least = overlaps(d["bbox"], k["bbox"])
            vehicles = name(d) in VEHICLES and name(k) in VEHICLES
            if iou > limits.nms_iou or least > limits.nms_iomin or vehicles and (iou > limits.vehicle_iou or least > limits.vehicle_iomin):
                break
        else:
            kept.append(d)
    return kept


# Classes that a truck is assembled from.
PARTS = {"truck", "car", "container"}


def _joinable(box: np.ndarray, part: np.ndarray, limits: Thresholds) -> np.ndarray:
    """For all boxes (rows of x1, y1, x2, y2) at once: which pairs i < j of parts make one truck."""
    low, high = box[:, :2], box[:, 2:]
    size = np.maximum(high - low, 1)
    common = np.minimum(high[:, None], high) - np.maximum(low[:, None], low)  # in x and y; below 0: a gap
    beside = np.maximum(common, 0) / np.minimum(size[:, None], size) >= limits.assemble_side
    near = -common <= limits.assemble_gap
    touch = (near & beside[..., ::-1]).any(2)
    shared = np.maximum(common, 0).prod(2).astype(float)
    area = np.maximum(high - low, 0).prod(1).astype(float)
    least, union = np.maximum(np.minimum(area[:, None], area), 1), np.maximum(area[:, None] + area - shared, 1)
    touch |= np.maximum(shared / least, shared / union) > limits.assemble_overlap
    whole = np.maximum(np.maximum(high[:, None], high) - np.minimum(low[:, None], low), 1)
    flat = whole.max(2) / whole.min(2) <= limits.assemble_aspect
    return np.triu(touch & flat & part[:, None] & part, 1)


def assemble(detections: list[dict], limits: Thresholds = DEFAULT) -> list[dict]:
    """Trucks from parts: as long as there is one, the first pair of parts that belong together is made one box, which comes last."""
    boxes = list(detections)
    for _ in range(limits.assemble_rounds):
        if len(boxes) < 2:
            break
        names = [d["class"].lower() for d in boxes]
        part = np.array([n in PARTS and d.get("source") != "custom" for n, d in zip(names, boxes)])
        corners = np.array([d["bbox"] for d in boxes])
        pairs = np.argwhere(_joinable(corners, part, limits))
        if not len(pairs):
            break
        two = pairs[0].tolist()
        # The truck's track goes on; of two other parts the later one's, if it has one.
        owner = two[0] if names[two[0]] == "truck" or boxes[two[1]].get("trackId") is None else two[1]
        edge = [*corners[two, :2].min(0).tolist(), *corners[two, 2:].max(0).tolist()]
        made = {"class": "truck", "confidence": round(max(boxes[k]["confidence"] for k in two), 3), "bbox": edge, "source": "assembled", "trackId": boxes[owner].get("trackId")}
        boxes = [d for k, d in enumerate(boxes) if k not in two] + [made]
    return boxes


def hysteresis(track: Iterable[tuple[int, float]], limits: Thresholds = DEFAULT) -> Iterator[tuple[int, float]]:
    """(frame, confidence) of one track -> the frames shown, with smoothed confidence."""
    level, last = None, 0
    for frame, confidence in track:
        if level is not None and frame - 1 - last > limits.forget_frames:
            level = None
        if confidence < (limits.initiate_confidence if level is None else limits.continue_confidence):
            continue
        level = confidence if level is None else limits.confidence_alpha * confidence + (1 - limits.confidence_alpha) * level
        last = frame
        yield frame, round(level, 3)


def stable_classes(track: Iterable[tuple[int, str, float]], limits: Thresholds = DEFAULT) -> Iterator[tuple[int, str]]:
    """(frame, class, confidence) of one track -> the class with most decayed votes at each frame; votes are forgotten with the track."""
    votes: dict[str, float] = {}
    last = 0
    for frame, name, confidence in track:
        if votes and frame - 1 - last > limits.class_forget_frames:
            votes = {}
        last = frame
        votes = {k: v * limits.class_decay for k, v in votes.items() if v * limits.class_decay >= limits.class_floor}
        votes[name] = votes.get(name, 0.0) + confidence
        yield frame, max(votes, key=lambda k: votes[k])


def _bare(plate: str) -> int:
    return len(plate.translate(str.maketrans("", "", " -.")))


def _lead(votes: dict[str, tuple[int, float]]) -> str:
    return max(votes, key=lambda p: (8.0 if 7 <= _bare(p) <= 9 else 4.0) + 2.5 * votes[p][1] + 0.4 * min(5, votes[p][0]))


def plate_leads(reads: Iterable[tuple[int, float, str, float]], limits: Thresholds = DEFAULT) -> Iterator[tuple[int, float, float, str, float]]:
    """(id, seconds, plate, confidence) of one track in the order of time -> (id, seconds, begin of the stay, plate that leads the vote, its confidence) of each read from the stay's first vote on."""
    begin, last, votes = 0.0, None, {}
    for read, at, plate, confidence in reads:
        if last is None or at - last > limits.track_expiry_seconds:
            begin, votes = at, {}
        last = at
        if _bare(plate) >= 6:
            n, best = votes.get(plate, (0, 0.0))
            votes[plate] = (n + 1, max(best, confidence))
        if votes:
            lead = _lead(votes)
            yield read, at, begin, lead, votes[lead][1]


def told_plates(leads: Iterable[tuple[float, int, float, str, float]], limits: Thresholds = DEFAULT) -> Iterator[tuple[float, int, str, float]]:
    """(seconds, track, begin of its stay, plate, confidence) in the order of time -> events: once a stay, and not within the cooldown after the plate's last event."""
    stays: dict[int, tuple[float, float]] = {}  # the stay that has been told, and the last read of it
    told: dict[str, float] = {}
    swept = None
    for at, track, begin, plate, confidence in leads:
        if swept is None or at - swept > limits.plate_cooldown_seconds:
            stays = {k: v for k, v in stays.items() if at - v[1] <= limits.track_expiry_seconds}
            told = {k: v for k, v in told.items() if at - v < limits.plate_cooldown_seconds}
            swept = at
        if track in stays and stays[track][0] == begin:
            stays[track] = begin, at
        elif plate not in told or at - told[plate] >= limits.plate_cooldown_seconds:
            stays[track], told[plate] = (begin, at), at
            yield at, track, plate, confidence


def gate_events(reads: Iterable[tuple[float, int, str, float]], limits: Thresholds = DEFAULT) -> Iterator[tuple[float, int, str, float]]:
    """(seconds, track, plate, confidence) read at one camera in the order of time -> events.

    An event is the plate that leads a track's vote once it has six characters: once for each stay of the track, and
    not within the cooldown after the last event of that plate by any track; a plate held back is told as soon as that
    has passed, if its track still stays. Only tracks of the last moments and plates in their cooldown are kept.
    """
    tracks: dict[int, list] = {}  # last read, votes, told
    told: dict[str, float] = {}
    swept = None
    for at, track, plate, confidence in reads:
        if swept is None or at - swept > limits.plate_cooldown_seconds:
            tracks = {k: v for k, v in tracks.items() if at - v[0] <= limits.track_expiry_seconds}
            told = {k: v for k, v in told.items() if at - v < limits.plate_cooldown_seconds}
            swept = at
        own = tracks.get(track)
        if own is None or at - own[0] > limits.track_expiry_seconds:
            own = tracks[track] = [at, {}, False]
        own[0], votes = at, own[1]
        if _bare(plate) >= 6:
            n, best = votes.get(plate, (0, 0.0))
            votes[plate] = (n + 1, max(best, confidence))
        if votes and not own[2]:
            lead = _lead(votes)
            if lead not in told or at - told[lead] >= limits.plate_cooldown_seconds:
                own[2], told[lead] = True, at
                yield at, track, lead, votes[lead][1]
