from thicket.cli import main

raise SystemExit(main())
