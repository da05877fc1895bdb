"""Tables: derived views, event logs and generated populations."""
