"""Part of textaxis; see the README for what each module holds."""
