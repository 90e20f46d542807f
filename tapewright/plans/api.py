"""The four public calls: start, resume, status, inspect. Steps that touch files or ask people are handed in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from tapewright.plans.workflow import Run, Store, WorkflowError

FLOWS = ("source_root", "relocate")


@dataclass
class Services:
    """What a flow does: dry_run(run, options) registers artefacts and gives the next phase; apply(run, plan) gives whether all went well."""

    store: Store
    dry_run: Callable[[Run, dict], str]
    apply: Callable[[Run, object], bool]
    now: Callable[[], str]
    defaults: dict = field(default_factory=lambda: {"maxFilesPerRun": 200, "scanErrorPolicy": "warn", "onDstExists": "error", "queueMissingMetadata": True})


def start(services: Services, flow: str, run_id: str, **options) -> dict:
    if flow not in FLOWS:
        raise WorkflowError("unknown_flow", flow)
    if not 1 <= (n := (services.defaults | options).get("maxFilesPerRun", 200)) <= 5000:
        raise WorkflowError("invalid_parameter", f"maxFilesPerRun {n}")
    run = Run(run_id, flow)
    services.store.save(run)
    return _step(services, run, lambda: services.dry_run(run, services.defaults | options))


def resume(services: Services, run_id: str, action: str = "apply_plan", artifact_id: str | None = None, gate_id: str | None = None, status: str = "approved") -> dict:
    run = services.store.load(run_id)
    if action == "resolve_gate":
        run.resolve_gate(gate_id or "", status, services.now())
        services.store.save(run)
        return result(run)
    if action == "apply_plan":
        plan = run.check_apply(artifact_id or "", run.flow, f"{run.flow}_plan")
        done = _step(services, run, lambda: "applied" if services.apply(run, plan) else "failed")
        if run.phase == "applied":
            run.advance("complete", services.now())
            services.store.save(run)
            done = result(run)
        return done
    if action == "rerun":
        return _step(services, run, lambda: services.dry_run(run, services.defaults))
    raise WorkflowError("unknown_action", action)


def status(services: Services, run_id: str | None = None, limit: int = 20) -> list[dict]:
    runs = [services.store.load(run_id)] if run_id else services.store.recent(max(1, min(limit, 100)))
    return [result(r) for r in runs]


def inspect(services: Services, run_id: str, artifact_id: str, preview_bytes: int = 0) -> dict:
    return services.store.inspect(run_id, artifact_id, preview_bytes)


def _step(services: Services, run: Run, work: Callable[[], str]) -> dict:
    try:
        phase = work()
        if phase != run.phase:
            run.advance(phase, services.now())
    except WorkflowError:
        raise
    except Exception as e:
        run.diagnostics.append({"code": "step_failed", "severity": "error", "message": str(e)})
        run.phase = "failed"
    services.store.save(run)
    return result(run)


def result(run: Run) -> dict:
    return {
        "ok": run.phase != "failed", "runId": run.run_id, "flow": run.flow, "phase": run.phase, "artifacts": list(run.artifacts), "nextActions": run.next_actions(),
        "gates": [{"id": g.id, "status": g.status} for g in run.gates.values()], "diagnostics": run.diagnostics,
    }
