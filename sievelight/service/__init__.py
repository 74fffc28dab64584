"""What stands around the engine: settings, model servers, reports, a line protocol and a command line."""
