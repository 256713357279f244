"""Pages and state: scans, sinks, address binding and the page classifier."""
