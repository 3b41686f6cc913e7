"""Which detectors exist and which of them a scan uses."""

import logging
from collections.abc import Callable, Iterable

from .builtin import BUILTIN
from .detector import Detector
from .names import NameDetector

log = logging.getLogger(__name__)


class Registry:
    """Detectors by lower-cased name, in the order they were added."""

    def __init__(self, detectors: Iterable[Detector] = ()) -> None:
        self._detectors: dict[str, Detector] = {}
        for detector in detectors:
            self.add(detector)

    def add(self, detector: Detector) -> None:
        """Add a detector; a name that is taken is ignored with a warning."""
        key = detector.name.lower()
        if key in self._detectors:
            log.warning("detector %s is already registered, ignoring the second one", detector.name)
            return
        self._detectors[key] = detector

    def add_built(self, build: Callable[[], Detector]) -> None:
        """Add what `build` returns; if it raises, that detector is left out and the others stay."""
        try:
            self.add(build())
        except Exception:
            log.exception("a detector could not be built and is left out")

    def all(self) -> list[Detector]:
        return list(self._detectors.values())

    def select(self, names: Iterable[str] | None = None) -> list[Detector]:
        """Detectors by name, in any case, each once. No names means all; unknown names are ignored."""
        names = list(names or ())
        if not names:
            return self.all()
        chosen: dict[str, Detector] = {}
        for name in names:
            detector = self._detectors.get(name.lower())
            if detector is None:
                log.warning("detector %s is not registered, ignoring it", name)
            else:
                chosen[name.lower()] = detector
        return list(chosen.values())


def default_registry(predictor_factory: Callable | None = None) -> Registry:
    """The seven rule detectors, and the name detector if a predictor is given."""
    registry = Registry(BUILTIN)
    if predictor_factory is not None:
        registry.add_built(lambda: NameDetector(predictor_factory=predictor_factory))
    return registry
