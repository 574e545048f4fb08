from gridloom.engine.session import checkpoint, ensure_checkpoint_dir, get_session, ship_package

__all__ = ["checkpoint", "ensure_checkpoint_dir", "get_session", "ship_package"]
