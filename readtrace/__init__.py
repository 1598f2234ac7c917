"""readtrace: multimodal reading-session analytics as Spark DataFrame transformations.

Recorded gaze samples, recognised words and keystrokes are joined per word of
the text being read, become timing metrics per sentence, a 17-feature vector
per session and a transparent weighted-threshold indicator, and are then
analysed across sessions and participants.  Every public function takes and
returns DataFrames (or Columns); nothing here pulls data to the driver other
than summaries of a bounded size.
"""

__version__ = "0.1.0"
