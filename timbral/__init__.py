"""timbral of the speech-signal and voice-biometric analytics engine."""
